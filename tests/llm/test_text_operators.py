"""The text operators against brute force, on small tables with every odd case: nulls in any column, empty
and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, secrets, substring_dedup, token_counts
from tessera.llm.automaton import compile_rules, scan, word

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, key string, n long, score double, more int, a int, b int"


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Éa", "ß", "the", "The", "don't", "a,b", "漢字", "x y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, rows = text(60), []
    for k in range(40):
        rows.append((k, text(rng.randint(0, 120))))
    base = text(300).split(" ")
    for k in range(40, 60):  # near copies of one text
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(k, text(30) + "\n" + passage + " \t " + text(20)) for k in range(60, 75)]
    rows += [(k, rows[k - 75][1]) for k in range(75, 85)]
    small = text(9).split(" ")
    rows += [(k, " ".join(small[:j] + small[j + 1 :])) for j, k in enumerate(range(85, 92))] + [(92, " ".join(small))]
    rows += [(93, None), (94, ""), (95, " \n\t "), (96, "one"), (97, "One"), (98, "two words"), (99, "x" * 30_000 + " " + passage), (100, " ".join(["again"] * 90)), (101, passage + " " + passage), (None, passage), (None, None), (5, rows[5][1]), (5, rows[5][1]), (102, text(20_000))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", 1, 0.5, None, 1, 2) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, rows, none):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = SPACED.findall((t or "").translate(LOW))
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = ngram_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_shingles, r.component) for r in got if r.id is not None} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert all(r.component is None for r in got if r.id is None)
    assert len({root(i) for i in range(40, 60)}) < 20  # the near copies do link
    assert ngram_join.jaccard_join(none).count() == 0


def test_pairs_of_equal_keys_are_checked(spark):
    """Pairs that a collision of keys would bring don't link; those that do link stay."""
    words = [f"w{k}" for k in range(40)]
    texts = {1: " ".join(words[:12]), 2: " ".join(words[20:32]), 3: " ".join([*words[:11], "other"]), 4: " ".join(words[:12]) + " more"}
    df = spark.createDataFrame([*texts.items()], "id long, text string")
    base = df.mapInArrow(ngram_join.summarise(4), ngram_join.BASE)
    sketches = base.where("kind = 0").select("id", "n", "sketch")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    got = {(r.a, r.b) for r in ngram_join.linked(pairs, sketches, df, 4, 85).collect()}
    assert got == {(1, 4)}


def test_light_sets_share_a_needed_subset():
    for n in range(1, 15):
        for m in range(n, 18):
            o = ngram_join.needed(n, m)
            if o <= n:
                assert o in ngram_join.subset_sizes(n) and o in ngram_join.subset_sizes(m)
    assert ngram_join.light_boundary({3: 100, 24: 1}) >= 3


def test_sketch_never_drops_a_link():
    rng = np.random.default_rng(3)
    for n in (5, 80, 700):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for gone in range(n // 8):
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)])
            x, y = (int.from_bytes(ngram_join.sketch(np.unique(v)), "little") for v in (a, b))
            if len(ngram_join.sketch(a)) == len(ngram_join.sketch(b)):
                assert (x ^ y).bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_substring_dedup(docs, rows, none):
    windows = collections.Counter()
    split = [SPACED.findall(t or "") for _, t in rows]
    for w in split:
        windows.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, split, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if windows[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        want.append((-1 if i is None else i, len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    got = [(-1 if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 1000
    assert substring_dedup.without_repeats(none).count() == 0
    assert substring_dedup.level_lengths(35) == [9, 18, 35]


def brute_hits(text, windows):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, items = set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if (own := windows.get(tuple(w[k : k + size]))) is not None:
                hit.update(range(k, k + size))
                items |= own
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontaminate(spark, docs, rows, none):
    some = [t for _, t in rows if t]
    bench = [(1, " ".join(some[3].split()[:20])), (2, " ".join(some[62].split()[35:70])), (3, "two WORDS"), (4, None), (5, ""), (6, "one"), (10, some[45]), (2, "again " * 14), (None, some[7])]
    windows: dict = {}
    for i, t in bench:
        w = ALNUM.findall((t or "").translate(LOW))
        size = min(13, len(w))
        if i is not None:
            for k in range(len(w) - size + 1 if size else 0):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((-1 if i is None else i, *brute_hits(t, windows)) for i, t in rows)
    for blocks in (2_000_000, 40):  # one block of items, and many
        got = decontaminate.contamination(docs, table, block_words=blocks).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == want
    kept = decontaminate.decontaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(none, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def odd_texts(n: int) -> list[str]:
    rng = random.Random(1)
    signs = [*"aàé'stmdrevl 12½٣\n\t́ ΣςİßŒ漢字ーあ😀‘!", "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "é", "  ", "<|", "|>", "\x00", "\x1c", "\x85"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["!" * 3000 + "a" * 3000]


def test_token_counts(docs, rows, none):
    lib, vocab = library(), token_counts.vocabulary(token_counts.default_path())
    texts = odd_texts(4000)
    assert token_counts.text_tokens(texts, vocab).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.token_counts(docs).collect()
    want = [(-1 if i is None else i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted((-1 if r.id is None else r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert token_counts.token_counts(none).count() == 0


def test_packing(spark, docs, rows, none):
    lib = library()
    texts = {k: t for k, t in enumerate(odd_texts(300) + [t for _, t in rows])}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = packing.packed(table, group_tokens=40_000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in texts.items():
        ids, at = [*lib.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.packed(docs).select("id").distinct().count() == len({i for i, _ in rows})
    assert packing.packed(none).count() == 0


def test_costs_are_balanced():
    rng = random.Random(2)
    sizes = [rng.randint(1, 3000) for _ in range(800)]
    cost = collections.Counter()
    for _, _, n, q, _ in packing.assign(sizes):
        cost[q] += n + n * n / 4096
    full = sorted(cost.values())[12:]
    assert full[-1] < 1.6 * full[len(full) // 2]


def brute_secrets(text):
    """(start, rule, end), rule by rule with Python's own matcher: the patterns of the contract and of the further rules."""
    begin, end = (rf"-----{w} (?:[A-Z0-9]+ )*PRIVATE KEY-----" for w in ("BEGIN", "END"))
    base64_, other = r"[A-Za-z0-9+/=\r\n\\]", r"(?:[^-]|-[^-])"
    patterns = [
        r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"AKIA[A-Z0-9]+",
        r"[0-9a-f]+",
        rf"{begin}(?:{other}*{end}|{base64_}*)",
        r"(?:gh[opusr]_|xox[abeoprs]-|AIza|[rs]k_(?:live|test)_|glpat-)[A-Za-z0-9_-]+",
        r"eyJ[A-Za-z0-9_.-]+",
    ]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            size = len(m[1] if k == 0 else m[0])
            if size >= (6, 20, 24, 0, 20, 30)[k] and (k < 5 or m[0].count(".") > 1 and ".eyJ" in m[0]):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets(spark, docs, none):
    rng = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", "passwd", '"', "'", " ", ":", "=", "abcdef0123", "AKIA", "ABCDEFGH12", "deadbeef", "ſecret", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----END ", ".", " é", "\n", "0123456789abcdef", "==", "😀", "ghp_", "eyJ", ".eyJ", "eyJhbGciOi.eyJzdWIi.Sfl-", "-", "sk_live_", "MIIEpAIBAAKCAQEA7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + [None, "", "f" * 100_000, "token=" + "x" * 20_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: brute_secrets(t or "") for k, t in enumerate(texts)}
    got = {r.doc_id: r for r in secrets.digest(table.withColumn("secrets", F.lit("clash")).withColumn("id", F.lit(0))).collect()}
    assert sum(map(len, want.values())) > 1000 and {k for w in want.values() for _, k, _ in w} == set(range(6))
    for k, spans in want.items():
        named = [(secrets.KINDS[kind], a, b) for a, kind, b in spans]
        assert got[k].spans == ",".join(f"{n}:{a}:{b}" for n, a, b in named), texts[k]
        base = ",".join(f"{n}:{a}:{b}" for n, a, b in named if n in secrets.BASE)
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(n == b for n, *_ in named) for b in secrets.BASE)
    clean = {r.doc_id: r.text for r in secrets.redacted(table).collect()}
    for k, t in enumerate(texts):
        gone = {i for a, _, b in want[k] for i in range(a, b)}
        assert (clean[k] or "").replace("[secret]", "") == "".join(c for i, c in enumerate(t or "") if i not in gone)
    assert clean[4000] is None
    assert secrets.redacted(docs).columns == docs.columns
    assert secrets.digest(none).count() == 0


def test_redaction_takes_the_body_of_a_key(spark):
    body = "\n".join(["MIIEpAIBAAKCAQEA7bq" * 3] * 4)
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN PRIVATE KEY-----\n{body}\n"
    df = spark.createDataFrame([(1, f"see {key} here"), (2, f"cut {cut} and prose")], "doc_id long, text string")
    assert [r.text for r in secrets.redacted(df).orderBy("doc_id").collect()] == ["see [secret] here", "cut [secret] and prose"]


def test_automaton_is_minimal_and_scans_across_lanes():
    auto = compile_rules([word("ab"), word("cb")])
    assert len(auto) == 5  # the start, after a, after c, and an end of either rule
    data = np.frombuffer(b"x" * 4095 + b"ab" + b"y" * 5000 + b"cb", np.uint8)
    hits, bits = scan(auto, data)
    assert hits.tolist() == [4096, len(data) - 1] and bits.tolist() == [1, 2]


def test_stages_keep_columns_of_any_name(spark, docs):
    from tessera.llm import quality

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    odd = docs.select("doc_id", "text").withColumns({c: F.lit(c) for c in ("__m", "__m_0", "__score", "matches", "matches_0", "score", "score_", "id", "key")})
    bench = spark.createDataFrame([(1, "the same words as no document has at all")], "item_id long, text string")
    for kept in (decontaminate.decontaminated(odd, bench), quality.good_documents(odd, labels, threshold=0.0)):
        assert kept.columns == odd.columns and kept.count() == odd.count()
        assert {tuple(r) for r in kept.select("__m", "__score", "score").distinct().collect()} == {("__m", "__score", "score")}


def test_look_up_with_hot_keys(spark, monkeypatch):
    from tessera.llm import arrow

    monkeypatch.setattr(arrow, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(arrow, "HOT_SHARE", 5)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(60)] + [(None, 99), (50, 98)], "k long, v long")
    table = rows.where("k < 50").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    want = {(r.k, r.v, r.n, r.low) for r in rows.join(table, "k", "left").collect()}
    got = arrow.look_up(rows, table, ["k"], "n", "left").select("k", "v", "n", "low").collect()
    assert {tuple(r) for r in got} == want and len(got) == 62


def test_substring_dedup_with_hot_grams(spark, monkeypatch):
    rng = random.Random(4)
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(k, " ".join(f"{rng.randrange(9**6)}" for _ in range(20)) + " " + common + f" {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    plain = {tuple(r) for r in substring_dedup.without_repeats(df).collect()}
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 3)
    assert {tuple(r) for r in substring_dedup.without_repeats(df).collect()} == plain
    assert all(removed == 40 for _, _, removed, _ in plain)
