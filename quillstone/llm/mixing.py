"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a value that has no weight of its own falls into ``other``, so
the number of cells is bounded by the weights (a parameter), not by the data.  A target weight says how much of a value
the mixture is to have, relative to its share of the tokens: its target share is that share times the weight, over the
sum of these.  (Absolute shares may be given to ``rake`` and ``mix`` instead.)

A cell's weight is its tokens.  Probabilities start at the budget (the share of all tokens that the mixture keeps) and
are raked to each marginal in turn until all are met; a probability never passes 1.  No target is missed for want of
tokens: the budget shrinks to what the scarcest values of each marginal allow, and further if the cells still can't meet
all marginals within ``TOLERANCE``.  A document stays if a hash of its identifier, as a number from 0 to 1, is below its
cell's probability, so the tokens of every marginal stand in the target proportions up to the spread of that sampling.
``report`` gives the natural, target and achieved shares.

The topic of a text is that whose words (``TOPICS``) it has most of, if at least ``LEAST_HITS`` and one in
``LEAST_SHARE`` of all; the first on the list wins ties, and other texts are general.

Cases: null in source or language is ``other``, a null or empty text is general and has no tokens; a document without
words has weight 0 and its cell's rate; very long texts are read once, as a whole; a target for a value that doesn't occur
is left out and the rest scaled up; in absolute targets a value without one of its own shares other's, and if the named
targets leave nothing for other, it gets its own share of the tokens and they are scaled down, so it is sampled like the
rest; only a target of 0 given to a value by name (other, too) erases it; repeated identifiers share their fate; rows with
a null identifier are hashed as an empty one; an empty table gives no rows; columns with clashing names are kept as they
are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, by_rows, table, through_disk, utf8

#: Rounds of raking, the share of all tokens that the mixture is to keep at most, and how far a marginal may be from its
#: target, as a part of it.
ROUNDS, BUDGET, TOLERANCE = 40, 0.85, 0.001
OTHER, GENERAL = "other", "general"
#: Target weights, relative to the natural shares; other has 1.  The five first sources count twice, English half, so that
#: languages are nearer to each other; the budget shrinks to what the wanted values have.
WEIGHTS: dict[str, dict[str, float]] = {
    "source": {f"src{i}": 2.0 if i < 5 else 1.0 for i in range(20)},
    "lang": {"en": 0.5, "de": 1.0, "fr": 1.0, "es": 1.0},
    "topic": {"law": 0.7, "commerce": 0.7, "technology": 1.0, "science": 1.0, "health": 1.0, "finance": 1.0, "politics": 1.0, "sport": 1.0, GENERAL: 1.0},
}
LEAST_HITS, LEAST_SHARE = 2, 200
# Words of the topics.
TOPICS: dict[str, tuple[str, ...]] = {
    "law": tuple("law legal license licence licensed copyright court judge liability warranty agreement clause contract statute defendant plaintiff attorney rights jurisdiction terms".split()),
    "commerce": tuple("buy price shop sale order cart checkout shipping delivery customer product store discount offer brand warehouse invoice refund".split()),
    "technology": tuple("software code computer data server network database algorithm program function variable compiler kernel browser api python java hardware".split()),
    "science": tuple("theory experiment physics chemistry biology research hypothesis molecule particle equation species genome laboratory telescope energy theorem".split()),
    "health": tuple("health patient doctor hospital disease treatment medicine clinical symptom vaccine therapy diagnosis surgery nurse diet".split()),
    "finance": tuple("bank money market stock interest loan investment tax fund credit debt inflation currency equity dividend budget".split()),
    "politics": tuple("government election minister parliament president policy senate vote party campaign reform treaty embassy congress".split()),
    "sport": tuple("team game player season league coach goal match score tournament championship football tennis olympic".split()),
}
_TOPIC_OF = {w.encode(): t for t, words in TOPICS.items() for w in words}


def topic_of(text: bytes) -> str:
    words = text.translate(WORD_BYTES).split()
    hits: dict[str, int] = {}
    for w in filter(_TOPIC_OF.__contains__, words):
        hits[_TOPIC_OF[w]] = hits.get(_TOPIC_OF[w], 0) + 1
    most = max(hits.values(), default=0)
    if most < LEAST_HITS or most * LEAST_SHARE < len(words):
        return GENERAL
    return next(t for t in TOPICS if hits.get(t) == most)


def measured(docs: DataFrame, known: dict[str, dict[str, float]]) -> DataFrame:
    """doc_id, the cell (a column for each of ``known``'s keys) and n_tokens of every row; no shuffle."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(3))
            cells = [pa.array(c, pa.string()) for c in cells_of(batch.column(1), batch.column(2), texts, known)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cells, pa.array([len(t.split()) for t in texts], pa.int64())], ["doc_id", *known, "n_tokens"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_rows(docs.select("doc_id", "source", "lang", "text"), make, ", ".join([f"doc_id {kind}", *(f"{k} string" for k in known), "n_tokens long"]))


def cells_of(source: pa.Array, lang: pa.Array, texts: list[bytes], known: dict[str, dict[str, float]]) -> list[list[str]]:
    """For each of ``known``'s keys the value of every row, other if it is not known."""
    own = {"source": source.to_pylist(), "lang": lang.to_pylist(), "topic": map(topic_of, texts)}
    return [[v if v in names and v is not None else OTHER for v in own[k]] for k, names in known.items()]


def shares(weights: dict[tuple, float], d: int) -> dict[str, float]:
    """Each value's share of the tokens in a marginal."""
    total, out = sum(weights.values()) or 1.0, {}
    for c, w in weights.items():
        out[c[d]] = out.get(c[d], 0.0) + w / total
    return out


def targets_of(weights: dict[tuple, float], relative: dict[str, dict[str, float]]) -> list[dict[str, float]]:
    """Target shares from target weights relative to the natural shares."""
    out = []
    for d, factors in enumerate(relative.values()):
        raw = {v: s * factors.get(v, 1.0) for v, s in shares(weights, d).items()}
        out.append({v: x / (sum(raw.values()) or 1.0) for v, x in raw.items()})
    return out


def feasible(weights: dict[tuple, float], targets: list[dict[str, float]], budget: float) -> float:
    """The budget, or what is left of it if in each marginal the scarcest value can give no more than it has."""
    least = 1.0
    for d, target in enumerate(targets):
        natural = shares(weights, d)
        wanted = {v: t for v, t in target.items() if t > 0 and natural.get(v, 0) > 0}
        least *= min((natural[v] * sum(wanted.values()) / t for v, t in wanted.items()), default=1.0)
    return min(budget, least)


def rake(weights: dict[tuple, float], targets: list[dict[str, float]], budget: float = BUDGET, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Probabilities of the cells: expected tokens meet each marginal of what the budget keeps, a probability never
    passing 1; the budget shrinks until all are met within ``TOLERANCE``."""
    cells = sorted(weights)
    if not cells:
        return {}
    w = np.array([weights[c] for c in cells], float)
    natural = [shares(weights, d) for d in range(len(targets))]
    goals = [_with_other(t, n.get(OTHER, 0.0)) for t, n in zip(targets, natural, strict=True)]
    index = [np.unique([c[d] for c in cells], return_inverse=True) for d in range(len(targets))]
    budget = feasible(weights, goals, budget)
    for attempt in range(30):
        p = np.full(len(cells), float(budget))
        for _ in range(rounds if not attempt else 10 * rounds):
            for (values, at), goal in zip(index, goals, strict=True):
                now = np.bincount(at, w * p, len(values))
                want = _wanted(values, goal, np.bincount(at, w, len(values)), budget * w.sum())
                p = np.minimum(1.0, p * np.where(now > 0, want / np.where(now > 0, now, 1.0), 1.0)[at])
        off = 0.0
        for (values, at), goal in zip(index, goals, strict=True):
            want = _wanted(values, goal, np.bincount(at, w, len(values)), budget * w.sum())
            off = max(off, np.max(np.abs(np.bincount(at, w * p, len(values)) - want) / np.where(want > 0, want, 1.0), initial=0.0))
        if off <= TOLERANCE or not w.sum():
            break
        budget *= 0.9
    return dict(zip(cells, p.tolist(), strict=True))


def _wanted(values: np.ndarray, goal: dict[str, float], have: np.ndarray, total: float) -> np.ndarray:
    """The tokens that each value is to have; those that don't occur leave theirs to the rest."""
    want = np.where(have > 0, np.array([goal.get(v, 0.0) for v in values.tolist()]), 0.0)
    return want * total / want.sum() if want.sum() > 0 else have * total / (have.sum() or 1.0)


def _with_other(target: dict[str, float], share: float) -> dict[str, float]:
    """target with one for other: what the named leave of 1, or, if they leave nothing, other's own ``share`` of the
    tokens, for which they are scaled down."""
    if OTHER in target:
        return target
    rest = 1.0 - sum(target.values())
    if rest > 1e-9 or not share:
        return target | {OTHER: max(0.0, rest)}
    return {k: v * (1.0 - share) for k, v in target.items()} | {OTHER: share}


def uniform(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the identifier alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def tokens_in_cells(rows: DataFrame, known: dict[str, dict[str, float]]) -> dict[tuple, float]:
    """The cells' weights of ``measured`` rows: one pass, one number for each cell to the driver."""
    sums = rows.groupBy(*known).agg(F.sum("n_tokens").alias("tokens_in_cell")).collect()
    return {tuple(r)[:-1]: float(r["tokens_in_cell"] or 0) for r in sums}


def probability(found: dict[tuple, float], names: list[str]) -> Column:
    """The probability of a row of ``measured`` by its cell."""
    if not found:
        return F.lit(0.0)
    pairs = [x for c, r in sorted(found.items()) for x in (F.lit("\x1f".join(c)), F.lit(r))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws("\x1f", *names)), F.lit(0.0))


def rates(weights: dict[tuple, float], known: dict[str, dict[str, float]], absolute: bool = False, budget: float = BUDGET) -> dict[tuple, float]:
    return rake(weights, list(known.values()) if absolute else targets_of(weights, known), budget)


def mix(docs: DataFrame, known: dict[str, dict[str, float]] = WEIGHTS, absolute: bool = False, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of docs, with all their columns.  known: weights relative to the natural shares, or absolute
    target shares.  Two passes over the texts, no shuffle of them."""
    held = docs.sparkSession.sparkContext.broadcast(rates(tokens_in_cells(measured(docs, known), known), known, absolute, budget))  # a number a cell
    at = {c: docs.columns.index(c) for c in ("source", "lang", "text")}
    number, schema = uniform(F.col("doc_id")), docs.schema

    def make():
        found = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cells = zip(*cells_of(batch.column(at["source"]), batch.column(at["lang"]), utf8(batch.column(at["text"])), known), strict=True)
            chance = np.array([found.get(c, 0.0) for c in cells])
            keep = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) < chance
            return batch.filter(pa.array(keep)).select(list(range(batch.num_columns - 1)))

        return step

    return by_rows(docs.select("*", number.alias("_number_of_the_row")), make, schema)


def report(docs: DataFrame, known: dict[str, dict[str, float]] = WEIGHTS, absolute: bool = False, budget: float = BUDGET) -> list[tuple[str, str, float, float, float]]:
    """(marginal, value, natural, target and achieved share of the tokens), the last of what the mixture keeps."""
    rows = through_disk(measured(docs, known), "measured")
    weights = tokens_in_cells(rows, known)
    goals = list(known.values()) if absolute else targets_of(weights, known)
    kept = tokens_in_cells(rows.where(uniform(F.col("doc_id")) < probability(rake(weights, goals, budget), list(known))), known)
    out = []
    for d, name in enumerate(known):
        natural, achieved = shares(weights, d), shares(kept, d)
        out += [(name, v, natural[v], goals[d].get(v, 0.0), achieved.get(v, 0.0)) for v in sorted(natural)]
    return out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = through_disk(measured(table(spark, sf_dir, "documents"), WEIGHTS), "measured")  # the texts are read once
    chance = probability(rates(tokens_in_cells(rows, WEIGHTS), WEIGHTS), list(WEIGHTS))
    out = rows.select("doc_id", *WEIGHTS, "n_tokens", chance.alias("chance"), uniform(F.col("doc_id")).alias("u"))
    return out.select("doc_id", *WEIGHTS, "n_tokens", F.round("chance", 6).alias("probability"), (F.col("u") < F.col("chance")).alias("kept"))


def _sql() -> str:
    """DuckDB: the rounds of raking written out one after the other, at the budget that the marginals allow."""
    known = {k: ", ".join(f"'{v}'" for v in t) for k, t in WEIGHTS.items()}
    fold = lambda k, c: f"CASE WHEN {c} IN ({known[k]}) THEN {c} ELSE 'other' END"
    factor = lambda k: "CASE " + k + " " + " ".join(f"WHEN '{v}' THEN {x!r}" for v, x in WEIGHTS[k].items()) + " ELSE 1.0 END"
    hits = ", ".join("len(list_filter(ws, lambda w: w IN (" + ", ".join(f"'{w}'" for w in words) + f"))) AS h{i}" for i, words in enumerate(TOPICS.values()))
    top = f"greatest({', '.join(f'h{i}' for i in range(len(TOPICS)))})"
    topic = f"CASE WHEN {top} < {LEAST_HITS} OR {top} * {LEAST_SHARE} < nw THEN '{GENERAL}' " + " ".join(f"WHEN h{i} = {top} THEN '{t}'" for i, t in enumerate(TOPICS)) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, {fold("source", "source")} AS source, {fold("lang", "lang")} AS lang, {topic} AS topic, n_tokens FROM (SELECT *, len(ws) AS nw, {hits} FROM (
  SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))))""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL)",
        "ts AS MATERIALIZED (SELECT sum(w) AS ts FROM w0)",
    ]
    for k in WEIGHTS:
        steps += [
            f"s_{k} AS MATERIALIZED (SELECT {k}, sum(w) / any_value(ts) AS s, sum(w) / any_value(ts) * {factor(k)} AS raw FROM w0, ts GROUP BY {k})",
            f"t_{k} AS MATERIALIZED (SELECT {k}, s, raw / sum(raw) OVER () AS t FROM s_{k})",
        ]
    least = " * ".join(f"(SELECT min(s / t) FROM t_{k} WHERE s > 0 AND t > 0)" for k in WEIGHTS)
    steps += [f"b AS MATERIALIZED (SELECT least({BUDGET}::DOUBLE, 1.0::DOUBLE * {least}) AS b, ts FROM ts)", "c0 AS MATERIALIZED (SELECT w0.*, b AS r FROM w0, b)"]
    n = 0
    for _ in range(ROUNDS):
        for k in WEIGHTS:
            steps += [
                f"m{n} AS MATERIALIZED (SELECT {k}, sum(w * r) AS now FROM c{n} GROUP BY 1)",
                f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, w, least(1.0, r * CASE WHEN now > 0 THEN t * (b * ts) / now ELSE 1 END) AS r FROM c{n} JOIN m{n} USING ({k}) JOIN t_{k} USING ({k}), b)",
            ]
            n += 1
    return f"""WITH {", ".join(steps)}
SELECT doc_id, source, lang, topic, n_tokens, round(r, 6) AS probability, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < r AS kept
FROM d JOIN c{n} USING (source, lang, topic)"""


OP2_SQL = _sql()
