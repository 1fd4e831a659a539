import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import conversations as cv

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], hashlib.md5(row[3].encode()).hexdigest())


def facts_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1] or " ", fault))
    return out


def by_tables(facts):
    """(cost, audit) row by row over all states, without a queue; one insertion at most before each row and at the end."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "")}

    def inserted(best):
        out = dict(best)
        for s, (c, t) in best.items():
            to = 3 if s == 2 else 2
            out[to] = min(out.get(to, (c + 5, t + "I")), (c + 5, t + "I"))
        return out

    for initial, fault in facts:
        new = {}

        def put(s, c, t, new=new):
            new[s] = min(new.get(s, (c, t)), (c, t))

        for s, (c, t) in inserted(best).items():
            put(s, c + 2, t + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            put(3 if s == 2 else 2, c + 1 + more, t + "R")
            if (s, initial) in step:
                put(step[s, initial], c + more, t + "K")
        best = new
    return min(v for k, v in inserted(best).items() if k in (0, 3))


def by_all_ways(facts):
    """The same from every sequence of edits, judged by the grammar's regular expression."""
    found = []
    for inserts in itertools.product(("", "u", "a"), repeat=len(facts) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(facts)):
            cost, audit, roles = 0, "", ""
            for ins, edit, (initial, fault) in zip(inserts, edits, facts, strict=False):
                cost += 5 * len(ins) + {"K": 0, "R": 1, "D": 2}[edit[0]] + 5 * (fault == "truncated" and edit != "D")
                audit += "I" * len(ins) + edit[0]
                roles += ins + {"K": initial, "R": edit[1:], "D": ""}[edit[0]]
                if edit != "D" and fault in ("blank", "duplicate"):
                    break
            else:
                if re.fullmatch("(s?(ua)+)?", roles + inserts[-1]):
                    found.append((cost + 5 * len(inserts[-1]), audit + "I" * len(inserts[-1])))
    return min(found)


def brute(rows, harm=True):
    out = {}
    for conv in {r[0] for r in rows}:
        held = sorted(((damage if harm else list)([r for r in rows if r[0] == conv])), key=order)
        facts = facts_of(held)
        cost, audit = by_tables(facts) if facts else (0, "")
        at = iter(held)
        lines, roles = [], ""
        for edit in audit:
            row = next(at) if edit != "I" else (0, 0, "", "")
            if edit != "D":
                role = row[2] if edit == "K" else "assistant" if roles[-1:] == "u" else "user"
                roles += role[0]
                lines.append(f"{role}:{row[3]}")
        turns = {r[1] for r in held} - {None}
        faults = [f for _, f in facts]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(facts)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = [*cv.COUNTS, "audit", "repaired_sha256"]


def values(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_the_lattice_matches_every_sequence_of_edits():
    draw = random.Random(5)
    for _ in range(60):
        facts = [(draw.choice("ssuuaax"), draw.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(draw.randint(0, 4))]
        want = by_all_ways(facts)
        assert by_tables(facts) == want
        assert list(cv.shortest(facts).values()) == [want]


def test_the_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = values(cv.op12_conversations(spark, DATA))
    assert got == brute(rows)
    assert len({v[6] for v in got.values()}) > 5


@pytest.mark.parametrize("long_rows", [1000, 3])
def test_edges_whole_or_in_pieces(spark, tmp_path, long_rows):
    draw = random.Random(long_rows)
    texts = ["Hello there.", "what?", "cut off", "", " \x0b\t", None, " ", "Ünï!", "long " * 5000 + "."]
    rows = [(c, draw.choice([None, 0, 1, 2, 3, 5, 9]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage"]), draw.choice(texts)) for c in [1, 2, 3, None, 5] for _ in range(draw.randint(1, 30))]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(40)] + [(8, 4, "user", "same.")] * 12 + [(9, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert values(cv.digested(cv.repaired(df, long_rows=long_rows, piece_rows=5))) == brute(clean, harm=False)
    assert values(cv.digested(cv.repaired(cv.damaged(df), long_rows=long_rows, piece_rows=4))) == {k: v for k, v in brute(rows).items() if damage([r for r in rows if r[0] == k])}
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert values(cv.op12_conversations(spark, str(tmp_path))) == brute(rows)


def test_empty_tables_and_other_names(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert values(cv.digested(cv.repaired(empty))) == {}
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert cv.op12_conversations(spark, str(tmp_path)).collect() == []
    rows = [("k", 0, "user", "Hi."), ("k", 1, "user", "Yes."), ("k", 2, "assistant", "No.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "who string, n int, says string, words string, piece int, md5 int")
    got = cv.repaired(df, "who", "n", "says", "words").collect()
    assert [(r["conv_id"], r["audit"], r["cost"], [tuple(m) for m in r["messages"]]) for r in got] == [("k", "DKK", 2, [("user", "Yes."), ("assistant", "No.")])]
    for long_rows in (1000, 1):
        got = cv.digested(cv.repaired(df.withColumn("who", F.lit(4)), "who", "n", "says", "words", long_rows=long_rows, piece_rows=2)).collect()
        assert [(r["conv_id"], r["audit"]) for r in got] == [(4, "DKK")]
