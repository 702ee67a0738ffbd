"""Operators 11 to 13 against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables
and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, prefix_trie, sharding

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# fill in the middle


def fim_brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_SCHEMA = "doc_id long, text string, id string, output string, form int, n long, h0 long"


def fim_rows():
    rng = random.Random(3)
    letters = "ab Z\n\t<>PSM1é漢😀.\x00"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, "<"), (303, "a<P"), (304, "x <P> y"), (305, "<M>"), (None, "abc def"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (306, "z" * 200_000), (307, "ab é " * 100_000), (308, "\n"), (-5, "minus one two")]
    return rows


def test_fim(spark):
    rows = fim_rows()
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in rows], FIM_SCHEMA).repartition(3)
    made = fim.transformed(docs)
    got = sorted(map(tuple, made.select("id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert got == sorted((fim_brute(*r) for r in rows), key=repr)
    back = made.select("id", fim.restored(F.col("form"), F.col("output")).alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(docs.limit(0)).count() == 0


def test_stretches_keep_units():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abcDE  .é") for _ in range(rng.randint(0, 60)))
        parts = list(fim.stretches(text, 7))
        assert "".join(p for _, p in parts) == text
        units = [u for _, p in parts for u in re.findall("[A-Za-z]+|[^A-Za-z]", p)]
        assert units == re.findall("[A-Za-z]+|[^A-Za-z]", text)


# the trie


def trie_brute(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks[conv].append(((turn is not None, turn or 0), content, role, text))
    talks = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        built[c] = tuple(talks.get(base, [])[:h] + own[h:])
    nodes = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += value
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(built[c]) == len(k))
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), children[k], leaves[k], saved[k], sha(ends)))
    return sorted(out, key=repr)


TRIE_SCHEMA = "conv_id long, turn long, role string, text string, family long, node string, words int, n int"


def talks(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 70), *range(90, 130), -3, -20, -27, 1000, 70_000, 140_003]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["yes", "no no", "", None, "a\tb c"])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]  # a large group of copies, more than one block of ids below
    rows += [(3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "bot", "tie a"), (4, None, "user", "first"), (5, 2, "user", "twice"), (5, 2, "user", "twice"), (None, 1, "user", "no conversation")]
    for c in (40, 41, 110, 111, 300, 321):  # long ones: bases, members, without a base; two of them start alike
        rows += [(c, t, "user", f"{'long' if c in (40, 300) else c} {t % 3}") for t in range(60)]
    return rows


@pytest.mark.parametrize("long", [prefix_trie.LONG, 20])
def test_trie(spark, long, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TRIE_SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(df, long=long).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == trie_brute(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TRIE_SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2, 3)], TRIE_SCHEMA)).count() == 0


# shards


def test_flow_is_cheapest():
    """Against the optimum by linear enumeration of augmenting exchanges: all integer flows of small problems."""
    rng = random.Random(4)

    def best(supplies, capacities, costs, i=0):
        if i == len(supplies):
            return 0
        least = None

        def deal(j, left, spent):
            nonlocal least
            if j == len(capacities):
                if not left:
                    rest = best(supplies, capacities, costs, i + 1)
                    if rest is not None and (least is None or spent + rest < least):
                        least = spent + rest
                return
            for n in range(min(left, capacities[j]) + 1):
                capacities[j] -= n
                deal(j + 1, left - n, spent + n * costs[i][j])
                capacities[j] += n

        deal(0, supplies[i], 0)
        return least

    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supplies = [rng.randint(0, 4) for _ in range(n)]
        capacities = [rng.randint(0, 4) for _ in range(m)]
        capacities[-1] += max(0, sum(supplies) - sum(capacities))
        costs = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = sharding.min_cost_flow(supplies, capacities, lambda i, j: costs[i][j])
        assert all(v > 0 for v in flow.values())
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supplies
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacities[k] for k in range(m))
        assert sum(costs[i][j] * v for (i, j), v in flow.items()) == best(supplies, list(capacities), costs)


SHARD_SCHEMA = "doc_id long, text string, shard string, size int, slot int, file string, row long"


def placed(sharded, spark):
    rows, shard, slot = sharded.placed()
    return [(r["doc_id"], r["text"], r[sharded.size], r[shard], r[slot], r["shard"], r["size"]) for r in rows.collect()]


def check_places(got, rows, shards, largest):
    assert sorted(((g[0], g[1]) for g in got), key=repr) == sorted(rows, key=repr)
    assert all(g[2] == len((g[1] or "").encode()) + 1 and g[5:] == ("own", 9) for g in got)
    loads = [0] * shards
    for s in range(shards):
        mine = sorted(g[4] for g in got if g[3] == s)
        assert mine == list(range(len(mine)))
        loads[s] = sum(g[2] for g in got if g[3] == s)
    assert max(loads) - min(loads) <= 2 * largest
    return loads


def test_reshard(spark):
    rng = random.Random(6)
    rows = [(k, "é" * rng.randint(0, 300)) for k in range(800)] + [(k, "copy" * 40) for k in range(800, 1200)] + [(None, None), (None, ""), (5, None), (5, "x"), (5, "x")]
    df = spark.createDataFrame([(i, t, "own", 9, 1, "f", 2) for i, t in rows], SHARD_SCHEMA).repartition(6)
    laid = sharding.laid_out(df, 5)
    old = {tuple(map(repr, g[:2])): g[3] for g in placed(laid, spark)}
    new = sharding.reshard(laid, 8)
    got = placed(new, spark)
    check_places(got, rows, 8, 601)
    supplies = laid.sizes(5)
    least = sum(max(0, n - c) for n, c in zip(supplies, sharding.even(sum(supplies), 8)))
    assert new.moved_bytes == least
    gone = sum(g[2] for g in got if old[tuple(map(repr, g[:2]))] != g[3])
    assert abs(gone - least) <= 13 * 601  # a document at each bound
    kept = {f.path for f in laid.files} & {f.path for f in new.files}
    assert len(kept) == len(laid.files) - new.rewritten and kept
    # fewer shards: the last ones are emptied, files of the first stay as they are
    back = sharding.reshard(new, 3)
    check_places(placed(back, spark), rows, 3, 601)
    assert {f.path for f in new.files if f.shard < 3} <= {f.path for f in back.files}
    # equal sizes already: nothing moves
    assert sharding.reshard(back, 3, back.sizes(3)).rewritten == 0


def test_reshard_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, "own", 9, 1, "f", 2) for i, t in rows], SHARD_SCHEMA)
    empty = sharding.reshard(sharding.laid_out(frame([])), 8)
    assert empty.files == [] and empty.placed()[0].count() == 0
    rows = [(1, "y" * 100_000), (2, "a"), (3, None)]
    giant = placed(sharding.reshard(sharding.laid_out(frame(rows)), 8), spark)
    assert sorted(((g[0], g[1]) for g in giant), key=repr) == sorted(rows, key=repr)
    same = [(1, None)] * 50
    check_places(placed(sharding.reshard(sharding.laid_out(frame(same)), 8), spark), same, 8, 1)
