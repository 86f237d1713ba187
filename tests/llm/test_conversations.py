import hashlib
import itertools
import random
import re
import zlib

import pytest

from lakewright.llm import conversation_repair, role_grammar
from lakewright.llm.queries import op13_conversation_repair
from lakewright.session import table

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def plain_search(symbols):
    """(cost, labels, roles) of the best edits, by strings from the end on: symbols are (first letter, fault)."""
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {g: (0, "", ()) if g in ("", "a") else None for g in nexts}
    for place in range(len(symbols), -1, -1):
        here = {}
        for g in nexts:
            options = [best[g]] if place == len(symbols) and best[g] else []
            if place < len(symbols):
                letter, fault = symbols[place]
                arcs = [("D", 3, g, ())]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    arcs += [("K", more, nexts[g][letter], (place,))] if letter in nexts[g] else []
                    arcs += [("R", 2 + more, nexts[g][x], (x + str(place),)) for x in "ua" if x in nexts[g]]
                options += [(c + best[to][0], label + best[to][1], row + best[to][2]) for label, c, to, row in arcs if best[to]]
            here[g] = min(options, default=None)
        for _ in range(4):
            for g in nexts:
                more = [(2 + here[to][0], "I" + here[to][1], (x,) + here[to][2]) for x, to in nexts[g].items() if x in "ua" and here[to]]
                here[g] = min([o for o in [here[g], *more] if o], key=lambda o: o[:2], default=None)
        best = here
    return best[""]


def brute_row(conv_id, rows):
    damaged = []
    for turn, role, text in rows:
        spelled = [" " if x is None else str(x) for x in (conv_id, turn)]
        kind = zlib.crc32(":".join(spelled).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, found = set(), []
    for _, role, text in damaged:
        bare = text.strip(BLANKS)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in damaged if t is not None}
    letters = [r[:1] for _, r, _ in damaged]
    cost, labels, edits = plain_search([(x, f) for x, f in zip(letters, found)])
    lines = [":".join(damaged[e][1:]) if isinstance(e, int) else ("user:" if e[0] == "u" else "assistant:") + (damaged[int(e[1:])][2] if e[1:] else "") for e in edits]
    assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
    counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return (conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(d):
    groups = {}
    for r in d.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return sorted((brute_row(k, v) for k, v in groups.items()), key=repr)


def plain(d):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in d.collect()), key=repr)


def messy(spark):
    """All roles and faults, nulls in any column, equal turns, repeated rows, one conversation of a third of all rows."""
    rng = random.Random(13)
    texts = ["Yes.", "No!", "Why?", "not ended", "not ended  \n", "", " \t", None, "é日本", "a.\x0b", "z" * 3000 + "."]
    rows = []
    for i in range(1500):
        conv = rng.choice([7, rng.randint(0, 150), rng.randint(0, 150)])
        rows.append((conv if conv % 31 else None, rng.choice([None, *range(12), 40]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice([*texts, f"own {i}.", f"own {i}?", f"own {i}"])))
    return spark.createDataFrame(rows + rows[:60], SCHEMA).selectExpr("*", "'x' AS pid", "1 AS fault", "2 AS digest", "3 AS kind", "4 AS copy", "5 AS _id")


@pytest.mark.parametrize("size", [1024, 3])
def test_rows_are_the_brute_force_rows(spark, size):
    """Also in blocks of three rows, so that costs and states go from block to block."""
    d = messy(spark)
    assert plain(conversation_repair.repaired(d, size)) == brute(d)


def test_empty_table_and_conversations_without_rows(spark):
    assert plain(conversation_repair.repaired(spark.createDataFrame([], SCHEMA))) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    d = spark.createDataFrame([(gone, 0, "user", "Yes.")], SCHEMA)
    assert plain(conversation_repair.repaired(d)) == brute(d) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark):
    d = table(spark, "/root/testdata/sf0.01", "conversations")
    assert plain(op13_conversation_repair(spark, "/root/testdata/sf0.01")) == brute(d)


def test_operator_gives_rows_and_labels(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "Yes")]
    counts, edits = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA))
    (block,) = edits.collect()
    assert counts.first().asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 2, "cost": 6}
    assert block.audit == "KIKKDK" and [(r.label, r.role, r.text) for r in block.repaired] == [("K", "system", "Be brief."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi?"), ("K", "assistant", "Yes")]


def test_search_against_all_edit_sequences():
    """Short inputs: every sequence of edits up to the cost that was found."""
    faults = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}

    def all_edits(symbols, limit):
        def go(i, cost, labels, roles):
            if cost > limit:
                return
            if i == len(symbols) and GRAMMAR.fullmatch(roles):
                yield cost, labels
            for x in "ua":
                yield from go(i, cost + 2, labels + "I", roles + x)
            if i < len(symbols):
                letter, fault = symbols[i]
                yield from go(i + 1, cost + 3, labels + "D", roles)
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    yield from go(i + 1, cost + more, labels + "K", roles + letter)
                    for x in "ua":
                        yield from go(i + 1, cost + 2 + more, labels + "R", roles + x)

        return min(go(0, 0, "", ""))

    rng = random.Random(3)
    cases = list(itertools.product(itertools.product("sua?", ["", "blank", "truncated"]), repeat=2)) + [tuple((rng.choice("sua?"), rng.choice(list(faults))) for _ in range(n)) for n in (1, 3, 3, 4, 4) for _ in range(12)]
    for symbols in cases:
        codes = bytes(role_grammar.symbol(letter, faults[f]) for letter, f in symbols)
        costs, steps = role_grammar.backward(codes, role_grammar.END)
        labels, state = "", 0
        for label, _, state in role_grammar.walk(steps, 0):
            labels += label
        labels += "I" * len(role_grammar.closing(state))
        assert (costs[0], labels) == all_edits(symbols, costs[0]) == plain_search([(x, f or None) for x, f in symbols])[:2]


def test_costs_of_blocks_are_the_costs_of_the_whole():
    rng = random.Random(8)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 30)))
        behind = role_grammar.END
        at = len(codes)
        while at > 0:
            cut = max(0, at - rng.randint(1, 7))
            behind = role_grammar.before(role_grammar.transfer(codes[cut:at]), behind)
            at = cut
        assert list(behind) == list(role_grammar.backward(codes, role_grammar.END)[0])


def test_a_hot_conversation_is_spread(spark):
    """A conversation of most rows lies in many ranges, each of its blocks of at most so many rows."""
    from pyspark.sql import functions as F

    d = spark.range(40_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    # small ranges are put together else
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = conversation_repair.blocks(conversation_repair.faults(d), 500).select("pid", F.size("roles").alias("n")).groupBy("pid").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 6 and max(p.n for p in parts) < 2 * 40_000 / len(parts) and max(p.most for p in parts) == 500
    counts, _ = conversation_repair.repair(d, 500)
    assert counts.first().cost == 0 and counts.first().gaps == 0
