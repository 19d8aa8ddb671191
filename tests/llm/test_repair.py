import hashlib
import itertools
import random
import re
import zlib

import pytest

from censora.llm import queries, repair
from censora.queries import Tables

DDL = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits) by trying all ways: the least pair from each state on, without checkpoints."""
    after = {0: (0, ""), 3: (0, "")}
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, ""), "a": (0, "")}
    del after

    def settle(best):
        for _ in range(4):
            for (state, role), to in steps.items():
                if role != "s" and to in best:
                    way = (best[to][0] + 5, "I" + best[to][1])
                    best[state] = min(best.get(state, way), way)
        return best

    best = settle(best)
    for initial, fault in reversed(rows):
        now = {}
        extra = 5 if fault == repair.CUT else 0
        for state in ("", "s", "u", "a"):
            ways = [(best[state][0] + 2, "D" + best[state][1])]
            if fault in (repair.OK, repair.CUT):
                for role in "sua":
                    to = steps.get((state, role))
                    if to is None:
                        continue
                    if role == initial:
                        ways.append((best[to][0] + extra, "K" + best[to][1]))
                    if role != "s":
                        ways.append((best[to][0] + 1 + extra, "R" + best[to][1]))
            now[state] = min(ways)
        best = settle(now)
    return best[""]


def test_edits_are_the_cheapest_and_ascii_least():
    kinds = [(i, f) for i in ("s", "u", "a", "t", "") for f in range(4)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.edits(list(rows)) == cheapest(rows)
    pick = random.Random(31)
    for _ in range(400):
        rows = [(pick.choice("suaaut"), pick.choice((0, 0, 0, 1, 2, 3))) for _ in range(pick.randint(4, 90))]
        cost, audit = repair.edits(rows)
        assert (cost, audit) == cheapest(rows)
        roles = "".join(r[:1] for r, _ in repair.applied(audit, [(i, "") for i, _ in rows]))
        assert re.fullmatch("(s?(ua)+)?", roles)


def brute(rows, damage):
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        own[conv] += [(turn, role, text)] * (2 if how == 3 else 1)
    out = []
    for conv, said in own.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()[:32]))
        faults, seen = [], set()
        for _, role, text in said:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append(repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.CUT if bare[-1] not in ".!?" else repair.OK)
            seen.add((role, text))
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] for _, r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, faults)))
        mended = "\n".join(f"{r}:{t}" for r, t in repair.applied(audit, [(r, t) for _, r, t in said]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(mended.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.fixture
def rows():
    pick = random.Random(32)
    out = [(None, 0, "user", "nobody."), (None, None, None, None), (900, 2, "user", None), (901, 7, "", "no role."), (902, 0, "user", " \t" * 40_000 + "x.")]
    out += [(903, k, "assistant", "again.") for k in (0, 0, 1, 5)] + [(904, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(700)]
    for conv in range(120):
        for turn in range(pick.randint(1, 7)):
            role = "system" if turn == 0 and conv % 3 == 0 else pick.choice(("user", "assistant", "tool"))
            out.append((conv, turn + pick.randint(0, 1), role, pick.choice(["Yes.", "No!", "maybe", "é\U0001f600?", f"Only {conv}. \n", "\v\f\r"])))
    return out


def test_query_against_brute_force(spark, rows, tmp_path, many_tasks):
    spark.createDataFrame(rows, DDL).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.structure_repair(Tables(spark, str(tmp_path)))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, damage=True)


def test_operator_on_plain_rows(spark, rows):
    said = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS key", "2 AS _kind", "3 AS audit", "4 AS records").na.fill(" ", ["role", "text"])
    audited = repair.audits(said)
    mended = repair.repaired(said, audited)
    hashes = {r[0]: r[1] for r in repair.digests(mended).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(str((*r, hashes.get(r[0], empty))) for r in audited.collect()) == brute(rows, damage=False)
    roles = {}
    for r in mended.orderBy("conv_id", "place").collect():
        roles.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(re.fullmatch("s?(ua)+", "".join(r)) for r in roles.values())
    assert repair.audits(said.limit(0)).count() == 0 and repair.repaired(said.limit(0), audited.limit(0)).count() == 0


def test_ids_of_text(spark):
    said = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "user", "Yes."), ("y", 0, "user", "Hi.")], DDL.replace("conv_id long", "conv_id string"))
    audited = repair.audits(said)
    assert sorted((r["conv_id"], r["cost"], r["audit"]) for r in audited.collect()) == [("x", 1, "KR"), ("y", 2, "D")]
    assert [tuple(r) for r in repair.repaired(said, audited).orderBy("conv_id", "place").collect()] == [("x", 0, "user", "Hi."), ("x", 1, "assistant", "Yes.")]
    assert repair.digests(repair.repaired(said, audited)).count() == 1
