"""Repair of conversations against a shortest-path search over whole audits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from quern.llm import conversations as cv

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "a": {"u": "u"}, "u": {"a": "a"}}


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over (row, last initial), ordered by cost and then audit; rows: (role, text, forced, truncated)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(said)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in NEXT[state]:
                heapq.heappush(queue, (cost + 5, audit + "I", i, role[0], said + ((role, ""),)))
        if i < len(rows):
            role, text, forced, truncated = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, said))
            if not forced:
                extra = 5 * truncated
                if role[:1] in NEXT[state]:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], said + ((role, text),)))
                for other in ("user", "assistant"):
                    if other[0] in NEXT[state]:
                        heapq.heappush(queue, (cost + extra + 1, audit + "R", i + 1, other[0], said + ((other, text),)))


def brute_force(table, damaged=True):
    """conv_id to the result columns; rows of one turn come in the order given here."""
    out, groups = {}, defaultdict(list)
    for conv_id, turn, role, text in table:
        groups[conv_id]
        space = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20 if damaged else 9
        role, text = space(role), space(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        groups[conv_id] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv_id, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, judged = set(), [0, 0, 0], []
        for _, role, text in rows:
            blank, repeated = not text.strip(SPACES), (role, text) in seen
            cut = not blank and text.rstrip(SPACES)[-1] not in ".!?"
            seen.add((role, text))
            for k, fault in enumerate((blank, repeated, cut)):
                if fault:
                    faults[k] += 1
                    break
            judged.append((role, text, blank or repeated, cut))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, said = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def random_table(seed, conversations, longest, texts=6):
    """Distinct turns, nulls among all columns, odd roles, and texts that repeat, are cut short or blank."""
    rnd, rows = random.Random(seed), []
    for conv_id in [None, *range(conversations)]:
        turns = rnd.sample(range(longest * 3), rnd.randint(1, longest))
        turns = [None if rnd.random() < 0.02 and k == 0 else t for k, t in enumerate(turns)]
        for turn in turns:
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ünit", None])
            text = rnd.choice([f"Text {rnd.randint(0, texts)}.", f"Cut {rnd.randint(0, texts)}", "Asked? \n", "", " \t", None, f"Fine {turn}!"])
            rows.append((conv_id, turn, role, text))
    rnd.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_against_shortest_paths(spark, scratch, seed):
    table = random_table(seed, 60, 14)
    rows = cv.damage(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert found(cv.summaries(cv.repair(rows, scratch, "gone"))) == brute_force(table)


def test_layers_against_shortest_paths():
    rnd = random.Random(5)
    for _ in range(3000):
        rows = [(rnd.choice(["s", "u", "a", "t"]), "", rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 12))]
        turns = tuple((cv.BLANK if f else cv.TRUNCATED if c else cv.FINE, r if r != "t" else "") for r, _, f, c in rows)
        assert cv.solve(turns) == cheapest(rows)[:2]


def test_matrices_chain_to_the_whole():
    rnd = random.Random(6)
    for _ in range(300):
        turns = tuple((rnd.choice([0, 0, 1, 2]), rnd.choice(["s", "u", "a", ""])) for _ in range(rnd.randint(0, 40)))
        at, left = rnd.randint(0, len(turns)), cv._END
        for part in (turns[at:], turns[:at]):
            m = cv.matrix(part)
            left = [min(m[4 * i + j] + left[j] for j in range(4)) for i in range(4)]
        assert left[cv.START] == cv.solve(turns)[0]


@pytest.mark.parametrize("longest_segment", [1, 3, 16])
def test_one_conversation_holds_most_rows(spark, scratch, longest_segment):
    table = random_table(11, 8, 10) + [(77, t, r, x) for _, t, r, x in random_table(12, 1, 400, 60) if t is not None]
    table = list({(c, t): (c, t, r, x) for c, t, r, x in table}.values())
    rows = cv.damage(spark.createDataFrame(table, SCHEMA).repartition(3))
    segments = scratch.cut(cv.repair(rows, scratch, "gone", segment_rows=longest_segment))
    assert found(cv.summaries(segments)) == brute_force(table)
    assert segments.where("conv_id = 77").count() >= len([r for r in table if r[0] == 77]) // (longest_segment + 1)


def test_segments_hold_the_repaired_rows(spark, scratch):
    table = random_table(21, 20, 9)
    segments = cv.repair(spark.createDataFrame(table, SCHEMA), scratch).collect()
    want = brute_force(table, damaged=False)
    for conv_id in want:
        own = sorted((r for r in segments if r.conv_id == conv_id), key=lambda r: (r.part, r.segment))
        said = [f"{a}:{b}" for r in own for a, b in zip(r.roles, r.texts)]
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == want[conv_id][-1] == own[-1].repaired_sha256
        assert [r.last for r in own] == [False] * (len(own) - 1) + [True]


def test_query_over_its_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.op12_conversation_repair(spark, sf_dir)) == brute_force(table)


def test_repeated_rows_long_texts_and_no_rows(spark, scratch):
    long = "word " * 400_000 + "end."
    table = [(1, 0, "user", "Hi.")] * 5 + [(1, 1, "assistant", long), (2, 0, "user", long), (2, 0, "user", long)]
    schema = SCHEMA + ", gone int, fault string, part int"
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in table], schema)
    assert found(cv.summaries(cv.repair(odd, scratch))) == brute_force(table, damaged=False)
    assert cv.summaries(cv.repair(cv.damage(odd.where("false")), scratch, "gone")).collect() == []


def test_every_row_dropped(spark, scratch):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = cv.damage(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA))
    assert found(cv.summaries(cv.repair(rows, scratch, "gone"))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
