"""Repair of conversations whose turns are damaged: the cheapest edits that leave (system?) (user assistant)+ or nothing.

Fault flags come from windows over a conversation's turns.  The sorted turns are then folded by ``aggregate``, which
carries four (cost, audit) structs, one for each state of the pattern (start, after a system turn, after a user turn,
after an assistant turn), and takes the least of the edits that lead to each.  Of two audits that lead to one state at one
cost neither begins with the other (they would differ in insertions only, which cost), so the least of structs is right
at every turn for the whole audit.

A conversation is folded in segments of 128 turns.  One of a single segment needs one shuffle.  The turns of a longer one
are numbered by ranges, each segment is folded from all four states, and sixteen neighbours at a time become one (a product
of matrices in which adding is taking the least), until one is left; its audit is then dealt to the segments again.  So
a conversation may hold any share of the turns, and only its answer, a letter a turn, is ever in one place.

Cases: a null text or role is one space (blank, and of no known role); turns without a number come first, equal numbers
are ordered by role, the text's first 64 characters and its hash, repeated rows are duplicates; rows without a
conversation are a conversation of their own; very long texts are kept whole; an empty table gives no rows; columns other
than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, numbered, table, through_disk

#: Turns of a segment, and segments that become one.
SEGMENT, FAN = 128, 16
#: Costs of another role, of deleting, of inserting, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More than any repair of 2^38 turns costs: the state can't be reached.
NEVER = 1 << 42
STATES = ("start", "system", "user", "assistant")
# In the fold I and R also tell of which role: I and R are a user's, J and S an assistant's.  The order of letters is the same.
INSERTED, KEPT, REROLED, DELETED = {"user": "I", "assistant": "J"}, "K", {"user": "R", "assistant": "S"}, "D"
WORD = r"[^\x20\x09-\x0D]"


def _best(*ways: Column) -> Column:
    return F.least(*ways) if len(ways) > 1 else ways[0]


def _go(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def with_insertions(four: Column) -> dict[str, Column]:
    """The four states if turns are inserted first: a user's wherever one may follow, then an assistant's."""
    user = _best(four["user"], *(_go(four[s], INSERT, INSERTED["user"]) for s in ("start", "system", "assistant")))
    assistant = _best(four["assistant"], _go(user, INSERT, INSERTED["assistant"]))
    return {"start": four["start"], "system": four["system"], "user": user, "assistant": assistant}


def step(four: Column, turn: Column) -> Column:
    """The four states after a turn."""
    before = with_insertions(four)
    initial, extra = turn["initial"], F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    extra = extra + F.when(turn["fault"].isin("blank", "duplicate"), NEVER).otherwise(0)

    def stays(state: Column, role: str) -> Column:
        same = initial == role[0]
        return _go(state, extra + F.when(same, 0).otherwise(REROLE), F.when(same, KEPT).otherwise(REROLED[role]))

    system = _go(before["start"], extra + F.when(initial == "s", 0).otherwise(NEVER), KEPT)
    ways = {
        "start": [], "system": [system], "user": [stays(before[s], "user") for s in ("start", "system", "assistant")], "assistant": [stays(before["user"], "assistant")],
    }
    return F.struct(*(_best(_go(before[s], DELETE, DELETED), *ways[s]).alias(s) for s in STATES))


def begun(state: Column) -> Column:
    """The four structs before any turn, from one of the states (its number)."""
    return F.struct(*(F.struct(F.when(state == i, 0).otherwise(NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(s) for i, s in enumerate(STATES)))


def ended(four: Column) -> Column:
    """The least (cost, audit) that leaves nothing or ends with an assistant's turn."""
    after = with_insertions(four)
    return F.least(after["start"], after["assistant"])


def times(first: Column, then: Column) -> Column:
    """Two neighbours' matrices (an array by the state before, of structs by the state after) as one."""

    def from_(four: Column) -> Column:
        def to(s: str) -> Column:
            legs = [(four[m], then[i][s]) for i, m in enumerate(STATES)]
            return F.least(*(_go(a, b["cost"], b["audit"]) for a, b in legs))

        return F.struct(*(to(s).alias(s) for s in STATES))

    return F.transform(first, from_)


def repaired(turns: Column, audit: Column) -> Column:
    """The turns that an audit leaves, as ``role:text``."""

    def edited(turn: Column, letters: Column) -> Column:
        each = F.filter(F.split(letters, ""), lambda c: (c != "") & (c != DELETED))

        def one(c: Column) -> Column:
            out = F.when(c == KEPT, F.concat(turn["role"], F.lit(":"), turn["text"]))
            for role in ("user", "assistant"):
                out = out.when(c == INSERTED[role], f"{role}:").when(c == REROLED[role], F.concat(F.lit(f"{role}:"), turn["text"]))
            return out

        return F.transform(each, one)

    groups = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))
    last = F.filter(F.split(F.regexp_extract(audit, "[IJ]*$", 0), ""), lambda c: c != "")
    last = F.transform(last, lambda c: F.when(c == INSERTED["user"], "user:").otherwise("assistant:"))
    return F.concat(F.flatten(F.zip_with(turns, groups, edited)), last)


ORDER = ("turn", "role", "head", "mark")


def segmented(rows: DataFrame, starts: list[int]) -> DataFrame:
    """A row for each conversation's segment: its turns in order, what counts say of them, and its matrix from ``starts``.

    rows: conv, seg, turn, role, text, head, mark and seen (whether an earlier segment has the same turn).
    """
    own = Window.partitionBy("conv", "seg").orderBy(*ORDER)
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"initial": initial, "before": F.lag(initial).over(own), "last_turn": F.lag("turn").over(own), "place": F.row_number().over(own)})
    again = F.row_number().over(Window.partitionBy("conv", "seg", "role", "text").orderBy("place")) > 1
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank").when(F.col("seen") | again, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )
    rows = rows.withColumn("fault", fault)
    one = F.struct("place", "turn", "role", "text", "initial", "fault")
    out = rows.groupBy("conv", "seg").agg(
        F.array_sort(F.collect_list(one)).alias("turns"), F.count_if(F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("turn") != F.col("last_turn")))).alias("different"),
        F.count_if(_illegal(F.col("before"), F.col("initial"))).alias("illegal"), F.min("turn").alias("least"), F.max("turn").alias("most"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    ends = F.struct(F.element_at("turns", 1)["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"), F.element_at("turns", 1)["turn"].alias("low"), F.element_at("turns", -1)["turn"].alias("high"))
    matrix = F.transform(F.array(*map(F.lit, starts)), lambda s: F.aggregate("turns", begun(s), step))
    return out.withColumns({"ends": ends, "matrix": matrix})


def _illegal(before: Column, after: Column) -> Column:
    return before.isNotNull() & ~F.concat(before, after).isin("su", "ua", "au")


COUNTS = ("different", "illegal", "least", "most", "blank", "duplicate", "truncated")


def joined(parts: Column) -> Column:
    """Neighbouring segments (an array in order) as one."""

    def two(a: Column, b: Column) -> Column:
        sums = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")}
        met = F.coalesce((a["ends"]["high"] == b["ends"]["low"]).cast("long"), F.lit(0))  # one number on both sides
        sums |= {"different": a["different"] + b["different"] - met, "illegal": a["illegal"] + b["illegal"] + F.coalesce(_illegal(a["ends"]["last"], b["ends"]["first"]).cast("long"), F.lit(0))}
        sums |= {"least": F.least(a["least"], b["least"]), "most": F.greatest(a["most"], b["most"])}
        ends = F.struct(a["ends"]["first"].alias("first"), b["ends"]["last"].alias("last"), a["ends"]["low"].alias("low"), b["ends"]["high"].alias("high"))
        return F.struct(*(sums[c].alias(c) for c in COUNTS), ends.alias("ends"), times(a["matrix"], b["matrix"]).alias("matrix"))

    summary = F.transform(parts, lambda x: F.struct(*(x[c].alias(c) for c in (*COUNTS, "ends", "matrix"))))
    return F.aggregate(F.slice(summary, F.lit(2), F.lit(FAN)), F.element_at(summary, 1), two)


def _answer(rows: DataFrame, *others: str) -> DataFrame:
    best = ended(F.element_at("matrix", 1))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("different"), F.lit(0))
    counts = (F.col(c) for c in ("blank", "duplicate", "truncated", "illegal"))
    return rows.select("conv", *others, gaps.alias("gaps"), *counts, best["cost"].alias("cost"), best["audit"].alias("audit"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation that has
    a turn.  turns: conv_id, turn, role, text."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.substring(text, 1, 64).alias("head"), F.xxhash64(text).alias("mark"))
    long = rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT).select(F.col("conv").alias("long_conv"))
    long = through_disk(long, "long-conversations")
    if long.isEmpty():
        return _short(rows)
    known, same = few(long), F.col("conv").eqNullSafe(F.col("long_conv"))
    return _short(rows.join(known, same, "left_anti")).unionByName(_long(rows.join(known, same, "left_semi")))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of one segment: windows, the fold and the answer need one shuffle."""
    one = segmented(rows.withColumns({"seg": F.lit(0).cast("long"), "seen": F.lit(False)}), [0])
    whole = F.array_join(repaired(F.col("turns"), F.col("audit")), "\n")
    return _public(_answer(one, "turns").withColumn("repaired_sha256", F.sha2(whole, 256)))


def _public(answers: DataFrame) -> DataFrame:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return answers.select(F.col("conv").alias("conv_id"), *(F.col(c).cast("long").alias(c) for c in names), F.translate("audit", "JS", "IR").alias("audit"), "repaired_sha256")


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of several segments."""
    rows = numbered(rows, "conv", *ORDER).drop("members").withColumn("seg", F.floor(F.col("pos") / SEGMENT))
    # which turns were seen before, from one row for each that occurs more than once
    same = F.sha2(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("null")), F.lit(":"), F.length("role"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    rows = rows.withColumn("same", same)
    first = rows.groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(few(through_disk(first, "repeated-turns")), "same", "left")
    rows = rows.withColumn("seen", F.coalesce(F.col("pos") > F.col("first"), F.lit(False))).drop("same", "first", "pos")
    segments = through_disk(segmented(rows, [0, 1, 2, 3]), "segments")
    summary = F.struct("seg", *COUNTS, "ends", "matrix")
    level, up = segments, None
    while up is None or not up.where("seg > 0").isEmpty():
        parts = level.select("conv", F.floor(F.col("seg") / FAN).alias("up"), summary.alias("x")).groupBy("conv", "up")
        up = parts.agg(joined(F.array_sort(F.collect_list("x"))).alias("x")).select("conv", F.col("up").alias("seg"), "x.*")
        level = up = through_disk(up, "joined-segments")
    answers = through_disk(_answer(up), "long-answers")
    chunks = F.regexp_extract_all("audit", F.lit(f"(?:[IJ]*[DKRS]){{1,{SEGMENT}}}(?:[IJ]+$)?"), F.lit(0))
    chunks = answers.select(F.col("conv").alias("of"), F.posexplode(chunks).alias("chunk", "letters"))
    met = segments.join(chunks, (F.col("seg") == F.col("chunk")) & F.col("conv").eqNullSafe(F.col("of")))
    left = repaired(F.col("turns"), F.col("letters"))
    bodies = met.select("conv", "seg", left.alias("left")).where(F.size("left") > 0).select("conv", "seg", F.array_join("left", "\n").alias("body"))
    digests = bodies.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_digests, "hashed long, repaired_sha256 string")
    out = answers.join(digests, F.col("conv").eqNullSafe(F.col("hashed")), "left").drop("hashed")
    return _public(out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's bodies, which come in order: one is held at a time."""
    now, state, done = None, None, []
    for batch in batches:
        for conv, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if state is not None and conv == now:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256()
            state.update(body.as_buffer())
    if state is not None:
        done.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["hashed", "repaired_sha256"])


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query: by the checksum of ``conv_id:turn`` turns are dropped, emptied, cut, repeated or a user's."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table; one that lost all its turns to the damage has nothing to repair."""
    turns = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("long"))
    got = repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("every_id")).distinct()
    out = every.join(got, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("every_id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql_go(state: str, cost: str, letter: str) -> str:
    return f"(lpad((substr({state}, 1, 15)::BIGINT + {cost})::VARCHAR, 15, '0') || substr({state}, 16) || {letter})"


def _sql_insertions(names: dict[str, str]) -> dict[str, str]:
    user = f"least({names['user']}, " + ", ".join(_sql_go(names[s], str(INSERT), "'I'") for s in ("start", "system", "assistant")) + ")"
    return names | {"user": user, "assistant": f"least({names['assistant']}, {_sql_go(user, str(INSERT), chr(39) + 'J' + chr(39))})"}


def _sql() -> str:
    states = {s: f"f.{s}_" for s in STATES}
    before = {s: f"c.{s}_" for s in STATES}
    stays = {r: f"extra + (initial <> '{r[0]}')::INT * {REROLE}, CASE WHEN initial = '{r[0]}' THEN 'K' ELSE '{REROLED[r]}' END" for r in ("user", "assistant")}

    def stay(state: str, role: str) -> str:
        cost, letter = stays[role].split(", ", 1)
        return _sql_go(before[state], cost, letter)

    ways = {
        "start": [], "system": [_sql_go(before["start"], f"extra + (initial <> 's')::INT * {NEVER}", "'K'")],
        "user": [stay(s, "user") for s in ("start", "system", "assistant")], "assistant": [stay("user", "assistant")],
    }
    after = ", ".join(f"least({', '.join([_sql_go(before[s], str(DELETE), chr(39) + 'D' + chr(39)), *ways[s]])}) AS {s}_" for s in STATES)
    closed = ", ".join(f"{x} AS {s}_" for s, x in _sql_insertions(states).items())
    none = "lpad({0}, 15, '0')"
    first = ", ".join(f"{none.format(repr('0') if s == 'start' else repr(str(NEVER)))} AS {s}_" for s in STATES)
    end = _sql_insertions(states)
    return f"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM z),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
f AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
t AS MATERIALIZED (SELECT *, (CASE fault WHEN 'truncated' THEN {TRUNCATED} WHEN '' THEN 0 ELSE {NEVER} END)::BIGINT AS extra FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
folded AS (
  SELECT conv_id, 0::BIGINT AS place, {first} FROM g
  UNION ALL
  SELECT c.conv_id, t.place, {after} FROM (SELECT conv_id, place, {closed} FROM folded f) c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.place = c.place + 1),
e AS (SELECT f.conv_id, least({end["start"]}, {end["assistant"]}) AS best FROM folded f JOIN g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.n = f.place),
letters AS (SELECT conv_id, unnest(string_split(substr(best, 16), '')) AS letter, generate_subscripts(string_split(substr(best, 16), ''), 1) AS i FROM e),
placed AS (SELECT *, count(*) FILTER (letter IN ('D', 'K', 'R', 'S')) OVER (PARTITION BY conv_id ORDER BY i) AS place FROM letters WHERE letter <> ''),
pieces AS (SELECT p.conv_id, i, CASE letter WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'K' THEN role || ':' || text WHEN 'R' THEN 'user:' || text ELSE 'assistant:' || text END AS piece
  FROM placed p LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.place = p.place WHERE letter <> 'D'),
whole AS (SELECT conv_id, string_agg(piece, chr(10) ORDER BY i) AS body FROM pieces GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 15)::BIGINT, 0) AS cost, coalesce(translate(substr(best, 16), 'JS', 'IR'), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


#: DuckDB: the same fold as a recursion over places, a state being its cost in 15 digits and its audit.
OP12_SQL = _sql()
