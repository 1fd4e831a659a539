"""Conversation structure repair: the cheapest edits that make a conversation's roles follow `(s?(ua)+)?`.

The edit lattice has nodes (rows read, grammar state) and is never built: Dijkstra's algorithm expands it from the first
row on, with the key (cost, audit), and stops at the first accepting end node it pops. The audit is the edits' initials in
order, so of equally cheap repairs the ASCII-least is found. Two audits of one node and one cost are never prefixes of each
other, as they hold the same rows and every insertion costs, so the order of two holds whatever follows.

Edits: Keep 0; Rerole to user or assistant 1; Delete 2, which blank and duplicate rows need; Insert an empty user or
assistant message 5; a truncated row that isn't deleted 5 more. A row's first fault counts: blank (nothing but spaces),
duplicate (role and text of an earlier row), truncated (the last character that is no space isn't `.`, `!` or `?`).

Conversations of up to LONG_ROWS rows are sorted within one shuffle by conversation and go through Python one by one.
Longer ones are split, whatever their length: their rows are dealt by ranges into pieces of PIECE_ROWS; the cheapest way
of each piece from each state to each state is found where it lies, the pieces' ways are chained in order, and each piece
gets its edits back. One task streams through a long conversation's ways (its audit is one string in the end), none
through its texts.

Edge cases: nulls in role or text are one space, so such roles are no part of the grammar and such texts blank; a null
turn comes first; rows of one turn go by role and by the MD5 of their texts; a null id is a conversation of its own; an
empty role has the initial space; rows that repeat are duplicates; an empty table gives an empty result. Ids of whole
numbers come back as bigint, all others as text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import bounded_batches, stored, table

KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after the system message, after a user's, after an assistant's message.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
LONG_ROWS = 1024
PIECE_ROWS = 512
#: Long ids up to this many are broadcast.
BROADCAST_IDS = 500_000
SPACES = " \\t\\n\\u000b\\f\\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MESSAGE = "struct<role:string,text:string>"


def shortest(facts: list[tuple[str, str]], start: int = 0, ends: tuple = ACCEPTING, every: bool = False) -> dict[int, tuple[int, str]]:
    """The state in which the cheapest repair ends, with its cost and audit; facts: initial and fault of each row.

    every: the cheapest to each of the ends that can be reached, not only the first."""
    n, heap, done, found = len(facts), [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        wanted = WANTED[state][1]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, wanted))
        if i < n:
            initial, fault = facts[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = cost + OPEN * (fault == "truncated")
                heapq.heappush(heap, (more + REROLE, audit + "R", i + 1, wanted))
                if (kept := NEXT.get((state, initial))) is not None:
                    heapq.heappush(heap, (more + KEEP, audit + "K", i + 1, kept))
    return found


def edited(rows: list[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[dict], int]:
    """The messages (role, text) that an audit leaves of the rows, and the state after them."""
    out, i = [], 0
    for edit in audit:
        role, wanted = WANTED[state]
        if edit == "I":
            out.append({"role": role, "text": ""})
            state = wanted
            continue
        if edit == "R":
            out.append({"role": role, "text": rows[i][1]})
            state = wanted
        elif edit == "K":
            out.append({"role": rows[i][0], "text": rows[i][1]})
            state = NEXT[state, rows[i][0][:1]]
        i += 1
    return out, state


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _groups(batches, keys: int = 1) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows that agree in the first `keys` columns: those values, and an iterator over the rest of each row,
    which has to be used up before the next group. Rows come one by one and aren't held."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    ahead = [next(rows, None)]

    def group(key):
        while ahead[0] is not None and ahead[0][:keys] == key:
            yield ahead[0][keys:]
            ahead[0] = next(rows, None)

    while ahead[0] is not None:
        key = ahead[0][:keys]
        yield key, group(key)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.string()


def _one_by_one(rows: DataFrame, id_type: str) -> DataFrame:
    schema = pa.schema([("conv_id", _arrow(id_type)), ("piece", pa.int64()), ("split", pa.bool_()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def repair(batches):
        def each():
            for (conv,), rows in _groups(batches):
                held, seen, facts = list(rows), set(), []
                for _, role, text, fault in held:
                    if fault != "blank" and (role, text) in seen:
                        fault = "duplicate"
                    seen.add((role, text))
                    facts.append((role[:1] or " ", fault))
                turns = {r[0] for r in held} - {None}
                gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
                (cost, audit), = shortest(facts).values()
                found = [f for _, f in facts]
                messages, _ = edited([r[1:3] for r in held], audit)
                yield conv, 0, False, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal("".join(x for x, _ in facts)), cost, audit, messages

        yield from _batched(each(), schema)

    # a conversation's rows may come in several batches, and stay together
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "md5").select("conv_id", "turn", "role", "text", "fault")
    return placed.mapInArrow(repair, _schema(id_type))


def _schema(id_type: str) -> str:
    return f"conv_id {id_type}, piece bigint, split boolean, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, messages array<{MESSAGE}>"


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; b's keys go."""
    b = b.withColumnsRenamed({k: f"b_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(b, on, how).drop(*[f"b_{k}" for k in keys])


def _in_pieces(rows: DataFrame, id_type: str, piece_rows: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", "md5").sortWithinPartitions("conv_id", "turn", "role", "md5")
    held = stored(dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("piece", F.expr(f"pos - (pos & 8589934591) % {piece_rows}")), "long-conversations")

    first = held.filter("fault IS DISTINCT FROM 'blank'").groupBy("conv_id", "role", "md5").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    facts = held.select("conv_id", "piece", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "role", "md5", "fault")
    facts = _met(facts, first, ["conv_id", "role", "md5"], "left")
    fault = F.expr("CASE WHEN fault IS DISTINCT FROM 'blank' AND pos > first THEN 'duplicate' ELSE fault END")
    facts = facts.select("conv_id", "piece", "pos", "turn", "initial", fault.alias("fault"))
    facts = stored(facts, "long-facts")
    spans = facts.groupBy("conv_id").agg(F.expr("coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)").alias("gaps"))

    way = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    ways_schema = pa.schema([("conv_id", _arrow(id_type)), ("piece", pa.int64()), ("n", pa.int64()), ("initials", pa.string()), *[(c, pa.int64()) for c in COUNTS[1:4]], ("ways", pa.list_(way))])

    def find(batches):
        def each():
            for (conv, piece), rows in _groups(batches, 2):
                held = [(x or " ", f) for x, f in rows]
                found = [f for _, f in held]
                ways = [{"a": a, "b": b, "cost": c, "audit": t} for a in range(4) for b, (c, t) in shortest(held, a, (0, 1, 2, 3), True).items()]
                yield conv, piece, len(held), "".join(x for x, _ in held), found.count("blank"), found.count("duplicate"), found.count("truncated"), ways

        yield from _batched(each(), ways_schema, 64)

    by_piece = facts.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos").select("conv_id", "piece", "initial", "fault")
    ways = by_piece.mapInArrow(find, f"conv_id {id_type}, piece bigint, n bigint, initials string, blank bigint, duplicate bigint, truncated bigint, ways array<struct<a:bigint,b:bigint,cost:bigint,audit:string>>")

    chain_schema = pa.schema([("conv_id", _arrow(id_type)), ("piece", pa.int64()), *[(c, pa.int64()) for c in COUNTS[1:]], ("audit", pa.string()), ("state", pa.int64())])

    def chain(batches):
        def each():
            for (conv,), rows in _groups(batches):
                best, held = {0: (0, "")}, []
                for *row, ways in rows:
                    step = {}
                    held.append(row)
                    for w in ways:
                        if w["a"] in best:
                            cost, audit = best[w["a"]]
                            new = (cost + w["cost"], audit + w["audit"])
                            step[w["b"]] = min(step.get(w["b"], new), new)
                    best = step
                cost, audit = min(best[x] for x in ACCEPTING if x in best)
                at, state, before = 0, 0, ""
                for k, (piece, n, initials, blank, duplicate, truncated) in enumerate(held):
                    end, left = at, n
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    end = len(audit) if k == len(held) - 1 else end
                    yield conv, piece, blank, duplicate, truncated, illegal(before + initials), cost if not k else 0, audit[at:end], state
                    state = edited([(x, "") for x in initials], audit[at:end], state)[1]
                    at, before = end, initials[-1]

        yield from _batched(each(), chain_schema, 64)

    chained = ways.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(chain, f"conv_id {id_type}, piece bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, state bigint")
    chained = stored(chained, "long-audits")
    starts = chained.groupBy("conv_id").agg(F.min("piece").alias("first"))
    chained = _met(chained, _met(starts, spans, ["conv_id"]), ["conv_id"]).withColumn("gaps", F.expr("CASE WHEN piece = first THEN gaps ELSE 0L END"))

    texts = held.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    both = _met(chained, texts, ["conv_id", "piece"])
    left = F.udf(lambda rows, audit, state: edited([(r["role"], r["text"]) for r in rows], audit, state)[0], f"array<{MESSAGE}>", useArrow=True)
    return both.select("conv_id", "piece", F.lit(True).alias("split"), *COUNTS, "audit", left("rows", "audit", "state").alias("messages"))


def repaired(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", long_rows: int = LONG_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, piece, split, gaps, blank, duplicate, truncated, illegal, cost, audit, messages (role, text).

    One row a conversation; of those above long_rows rows (split) one for each piece, in the order of piece: audits and
    messages go end to end and numbers add up."""
    spark = rows.sparkSession
    bounded_batches(spark)
    id_type = rows.select(id_col).schema[0].dataType.simpleString()
    id_type = "bigint" if id_type in ("bigint", "int", "smallint", "tinyint") else "string"
    text = F.coalesce(F.col(text_col), F.lit(" "))
    full = F.expr(f"rtrim('{SPACES}', text)")
    held = rows.select(F.col(id_col).cast(id_type).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"))
    held = held.withColumns({"md5": F.md5("text"), "fault": F.when(full == "", "blank").when(~F.right(full, F.lit(1)).isin(".", "!", "?"), "truncated")})
    long = held.groupBy("conv_id").count().filter(f"count > {long_rows}").select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long"))
    many = long.count()
    if not many:
        return _one_by_one(held, id_type)
    long = stored(long, "long-ids")
    told = held.join(F.broadcast(long) if many <= BROADCAST_IDS else long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left").drop("long_id")
    return _one_by_one(told.filter("long IS NULL").drop("long"), id_type).unionByName(_in_pieces(told.filter("long").drop("long"), id_type, piece_rows))


def digested(pieces: DataFrame) -> DataFrame:
    """conv_id, the numbers, audit and repaired_sha256 (of `role:text` lines) of each conversation of repaired()."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    pieces = pieces.select("conv_id", "piece", "split", *COUNTS, "audit", lines.alias("lines"))
    whole = pieces.filter("NOT split").select("conv_id", *COUNTS, "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(id_type)), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def each():
            for (conv,), held in _groups(batches):
                digest, audit, sums, begun = hashlib.sha256(), [], [0] * len(COUNTS), False
                for *numbers, part, lines in held:
                    sums = [a + b for a, b in zip(sums, numbers, strict=True)]
                    audit.append(part)
                    for line in lines:
                        digest.update(b"\n" * begun + line.encode("utf-8", "surrogatepass"))
                        begun = True
                yield (conv, *sums, "".join(audit), digest.hexdigest())

        yield from _batched(each(), schema)

    split = pieces.filter("split").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", *COUNTS, "audit", "lines")
    return whole.unionByName(split.mapInArrow(run, f"conv_id {id_type}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of what the query's damage leaves."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    held = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    done = digested(repaired(damaged(rows)))
    out = ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _step(key: str, cost: str, edit: str) -> str:
    """SQL: a key (six digits of cost, then the audit) with one edit more."""
    return f"CASE WHEN {key} IS NOT NULL THEN lpad((left({key}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({key}, 7) || '{edit}' END"


def _inserted(k: tuple[str, str, str, str]) -> str:
    return f"{k[0]} AS k0, {k[1]} AS k1, least({k[2]}, {', '.join(_step(k[s], '5', 'I') for s in (0, 1, 3))}) AS k2, least({k[3]}, {_step(k[2], '5', 'I')}) AS k3"


_OPEN, _GOOD = "(5 * (fault = 'truncated')::INT)", "fault NOT IN ('blank', 'duplicate')"
_KEPT = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}
_NEXT = [
    f"least({', '.join([_step(f'k{s}', '2', 'D'), *[f'CASE WHEN {_GOOD} AND initial = {chr(39)}{x}{chr(39)} THEN ' + _step(f'k{a}', _OPEN, 'K') + ' END' for a, x in _KEPT.get(s, [])], *[f'CASE WHEN {_GOOD} THEN ' + _step(f'k{a}', f'1 + {_OPEN}', 'R') + ' END' for a in range(4) if WANTED[a][1] == s]])})"
    for s in range(4)
]
OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 20 AS kind FROM w, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS tail FROM d),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM r),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id),
l AS (SELECT conv_id, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) WHERE before IS NOT NULL GROUP BY conv_id),
p AS (SELECT conv_id, n, 0::BIGINT AS i, '000000' AS k0, NULL::VARCHAR AS k1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3 FROM g
  UNION ALL SELECT conv_id, n, i, {', '.join(_NEXT)} FROM (SELECT q.conv_id, q.n, f.i, f.initial, f.fault, {_inserted(('q.k0', 'q.k1', 'q.k2', 'q.k3'))} FROM p q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1)),
e AS (SELECT conv_id, least(k0, k3) AS key FROM (SELECT conv_id, {_inserted(('k0', 'k1', 'k2', 'k3'))} FROM p WHERE i = n)),
a AS (SELECT conv_id, left(key, 6)::BIGINT AS cost, substr(key, 7) AS audit FROM e),
t AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS place FROM a),
u AS (SELECT conv_id, place, substr(audit, place, 1) AS edit, len(replace(left(audit, place), 'I', '')) AS i, len(replace(left(audit, place), 'D', '')) AS m FROM t),
v AS (SELECT u.*, f.role, f.text, f.initial FROM u LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.i = u.i WHERE u.edit <> 'D'),
s AS (SELECT conv_id, count(*) FILTER (m = 1 AND edit = 'K' AND initial = 's') AS shift FROM v GROUP BY conv_id),
x AS (SELECT v.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS held
  FROM v JOIN s ON s.conv_id IS NOT DISTINCT FROM v.conv_id GROUP BY v.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(held, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
