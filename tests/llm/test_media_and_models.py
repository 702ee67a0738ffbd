"""Archives, pictures, classifiers and the pipeline."""

import base64
import hashlib
from itertools import chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, quality, toxicity, warc
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def test_warc_round_trip(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(40)]
    rows += [(100, "a b\r\n", "nul\x00\r\n\r\n"), (101, None, None), (102, "http://x/é", ""), (None, "u", rows[8][2]), (None, "v", "alone"), (103, "big", "X" * 3_000_000 + "é"), (3, "http://x/3", rows[3][2])]
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        own = first.get(h)
        again = own is not None and own != i
        want.append((-1 if i is None else i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", own if again else -1))
    df = spark.createDataFrame([(i, u, h, None) for i, u, h in rows], "page_id long, url string, html string, first long").repartition(3)
    got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.round_trip(df).collect()]
    assert sorted(got) == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_chunks_hold_the_payload(spark):
    html = "é" * 700_000
    df = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "short")], "page_id long, url string, html string")
    chunks = warc.read_chunks(warc.write_archives(df), chunk=100_000).orderBy("record", "chunk").collect()
    whole = [r for r in chunks if r.record == "<urn:page:1>"]
    assert len(whole) == 14 and b"".join(bytes(r.data) for r in whole).decode() == html
    assert [r.chunk for r in whole] == list(range(14)) and whole[-1].last and not whole[0].last
    assert whole[2].digest == base64.b32encode(hashlib.sha1(html.encode()[:300_000]).digest()).decode()
    assert [r.type for r in chunks if r.record == "<urn:page:2>"] == ["revisit"]


def test_media_copies_reach_brute_force(spark):
    pictures = media.drawn(spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").where("vec_id < 400"))
    flat = spark.createDataFrame([(9001, bytearray(4096)), (9002, None), (9003, b"short"), (None, bytearray(4096))], "id long, picture binary")
    twin = pictures.where("id = 1").select(F.lit(9004).cast("long").alias("id"), "picture")
    found = media.copies(pictures.unionByName(flat).unionByName(twin), "id % 20 = 0").collect()
    got = {(r.query_id, r.match_id) for r in found}
    want = {(q, q + v) for q in range(0, 400, 20) for v in (1, 2)}  # brute force: the drawn copies of each scene
    assert len(got & want) >= 0.9 * len(want)
    assert not {(q, m) for q, m in got if m // 4 != q // 4}
    assert next(r.members for r in found if r.match_id == 1) == 2
    assert media.copies(pictures.limit(0), "id % 20 = 0").count() == 0


def taken(canvas, x, y, zoom, degrees, rng, noise, gain, shift):
    """A picture of a part of a canvas: off the grid, zoomed, turned, with noise and another brightness."""
    v, u = np.mgrid[0:64, 0:64] - 31.5
    a = np.deg2rad(degrees)
    px, py = x + (np.cos(a) * u - np.sin(a) * v) / zoom, y + (np.sin(a) * u + np.cos(a) * v) / zoom
    i, j = np.clip(np.floor(py).astype(int), 0, len(canvas) - 2), np.clip(np.floor(px).astype(int), 0, len(canvas) - 2)
    f, g = np.clip(py - i, 0, 1), np.clip(px - j, 0, 1)
    out = (canvas[i, j] * (1 - g) + canvas[i, j + 1] * g) * (1 - f) + (canvas[i + 1, j] * (1 - g) + canvas[i + 1, j + 1] * g) * f
    return np.clip(out * gain + shift + rng.normal(0, noise, out.shape), 0, 255).astype(np.uint8)


def hard_copies(scenes):
    """Three pictures a scene: as it is; moved, enlarged and tilted; moved, zoomed, turned, noisy and darker."""
    out = []
    for k in range(scenes):
        rng = np.random.default_rng(1000 + k)
        canvas = 70 + media._resized(rng.random((1, 30, 30), np.float32) * 120, 120)[0]
        for _ in range(26):
            y, x = rng.integers(0, 114, 2)
            h, w = rng.integers(3, 16, 2)
            canvas[y : y + h, x : x + w] = rng.integers(10, 240)
        place = lambda: rng.uniform(51, 69)
        out += [taken(canvas, 60, 60, 1, 0, rng, 0, 1, 0), taken(canvas, place(), place(), rng.uniform(1.0, 1.35), rng.uniform(-8, 8), rng, 2, 1, 0)]
        out.append(taken(canvas, place(), place(), rng.uniform(0.8, 1.2), rng.choice([0, 90, 180, 270]) + rng.uniform(-20, 20), rng, 3, 0.9, 12))
    return out


def test_media_recall_is_that_of_the_pair(spark, monkeypatch):
    """Recall against comparing all descriptors, alone and among 2,000 unrelated pictures: the same pairs are found, whatever
    else is there, however many partitions, and whether keys are split or not."""
    import pyarrow as pa

    pictures = hard_copies(120)
    described = media._describe(iter([pa.record_batch([pa.array(range(len(pictures)), pa.int64()), pa.array([p.tobytes() for p in pictures]), pa.array([None] * len(pictures), pa.int32())], ["key", "picture", "width"])]))
    corners = {k: c for b in described for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    pairs = [(3 * k + i, 3 * k + j) for k in range(120) for i in range(3) for j in range(i + 1, 3)]
    pairs = [(a, b) for a, b in pairs if a in corners and b in corners]
    compared = media._compare(iter([pa.record_batch([pa.array(x) for x in ([a for a, _ in pairs], [b for _, b in pairs], [corners[a] for a, _ in pairs], [corners[b] for _, b in pairs])], ["a", "b", "ca", "cb"])]))
    truth = {(min(a, b), max(a, b)) for x in compared for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert len(truth) > 250
    own = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(pictures)], "id long, picture binary")
    others = media.drawn(spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").where("vec_id < 2000")).select((F.col("id") + 10_000).alias("id"), "picture")

    def found(df):
        return {tuple(sorted((r.query_id, r.match_id))) for r in media.copies(df).collect() if r.query_id < 10_000 and r.match_id < 10_000}

    alone = found(own)
    assert len(alone & truth) >= 0.9 * len(truth)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    among = found(own.unionByName(others).repartition(64))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert among == alone
    monkeypatch.setattr(media, "CROWD", 3)
    assert found(own) == alone


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    move, bounds = rng.normal(size=(2, 2)), np.array([0, 3, 3, 4, 9])
    score = rng.normal(size=9)
    good, pair, at = quality.marginals(score, move, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n, total, ones = b - a, 0.0, np.zeros(b - a)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum((1 if v else -1) * s / 2 for v, s in zip(y, score[a:b], strict=True)) + sum(move[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
        if n:
            assert np.allclose(good[a:b], ones / total)
    assert at.tolist() == [1, 2, 5, 6, 7, 8] and np.allclose(pair.sum(axis=(1, 2)), 1)


ODD = [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (None, "one two"), (9005, "x " * 20_000), (9005, "x " * 20_000)]


def odd(spark, docs):
    extra = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))


def test_quality_is_right_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(t) for c, t in labels.dtypes]))
    got = quality.scored(odd(spark, docs), labels, "__s").join(labels.where("quality is not null"), "doc_id").where(quality.held_out(F.col("doc_id")))
    right = got.agg(F.avg(((F.col("__s") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.98
    every = quality.scored(odd(spark, docs.limit(50)), labels, "__s")
    assert every.count() == 57 and every.where("__s is null or __s < 0 or __s > 1").count() == 0
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 0.95
    assert quality.good_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_is_right_on_other_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen, new = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    got = toxicity.scored(odd(spark, docs), seen, "t").join(new, "doc_id").select("t.toxic", new["toxic"].alias("truth")).toPandas()
    flagged = got["toxic"] >= toxicity.THRESHOLD
    assert (flagged == (got.truth == 1)).mean() > 0.97
    assert flagged[got.truth == 1].mean() > 0.9
    assert toxicity.scored(odd(spark, docs.limit(20)), seen, "t").where("t.toxic is null").count() == 0
    none = toxicity.scored(docs.limit(3), labels.limit(0), "t").select("t.toxic").collect()
    assert [r[0] for r in none] == pytest.approx([0.5] * 3)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    chosen = np.arange(1, 6, dtype=np.uint64)
    docs = []
    for _ in range(400):
        a = int(rng.random() < 0.5)
        noise = (chosen[2:][rng.random(3) < 0.5]).tolist()
        h = np.array(sorted(([1] if a else []) + noise), np.uint64)
        docs.append((int(rng.integers(1000)), h, np.ones(len(h), np.float32), [a, a]))
    chain = toxicity.fit_chain(["first", "second"], chosen, docs)
    assert chain.models[1].earlier[0] > 0.1


def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm import decontaminate, ngram_join, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_rows = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (None, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "s", 5)], docs.schema)
    at, kept = docs.unionByName(odd_rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        at = spark.createDataFrame(at.toPandas(), at.schema) if name == "none" else at
        from tessera.llm.arrow import saved

        at = saved(at, "stage")
        kept[name] = at.count()
        if name != "packing":
            assert at.columns == docs.columns and 0 < kept[name] <= before.count()
        if name == "near_copies":
            groups = ngram_join.jaccard_join(before, k=5, percent=80).where("id = component").count()
            assert at.where("doc_id is not null").count() == groups
        if name == "decontaminate":
            assert decontaminate.contamination(at, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "secrets":
            assert secrets.digest(at).where("n_hex > 0").count() == 0
            assert at.where("n_chars <> length(text)").count() == 0
    assert kept["near_copies"] < kept["quality"] and kept["packing"] >= kept["secrets"]


def altered(rng, scenes):
    """Scenes as they are, cropped off the grid with noise, turned with noise: (id, picture)."""
    out = []
    for s in range(scenes):
        whole = media.draw(s, 0, np.zeros(0)).astype(float)
        a, b = rng.integers(0, 9, 2)
        crop = media._resized(whole[None, a : a + 55, b : b + 55].astype(np.float32), 64)[0]
        for k, x in enumerate((whole, crop + rng.normal(0, 3, (64, 64)), np.rot90(whole) + rng.normal(0, 5, (64, 64)))):
            out.append((3 * s + k, np.clip(x, 0, 255).astype(np.uint8)))
    return out


def exhaustive(pictures):
    """(query, match): inliers, by all distances and votes in plain loops."""
    seen = {i: [x[1:] for x in zip(*media.described(p[None]), strict=True)] for i, p in pictures}
    bits = {i: np.unpackbits(np.array([[c[4], c[5]] for c in cs], np.int64).view(np.uint8), axis=1) for i, cs in seen.items()}
    out = {}
    for q in seen:
        for m in seen:
            if q == m:
                continue
            cells: dict = {}
            for a, b in np.argwhere((bits[q][:, None] != bits[m][None]).sum(axis=2) <= media.HAMMING):
                (qy, qx, ql, qa), (y, x, level, angle) = seen[q][a][:4], seen[m][b][:4]
                zoom, turn = media.SCALES[ql] / media.SCALES[level], int(angle - qa) % 32
                t = turn * 2 * np.pi / 32
                qy, qx, y, x = (float(np.float32(v / media.SCALES[lv])) for v, lv in ((qy, ql), (qx, ql), (y, level), (x, level)))
                dx, dy = x - zoom * (np.cos(t) * float(qx) - np.sin(t) * float(qy)), y - zoom * (np.sin(t) * float(qx) + np.cos(t) * float(qy))
                for i in (0, 0.5):
                    for j in (0, 0.5):
                        for k in (0, 0.5):
                            cell = np.sign(level - ql), i, (turn / 4 + i) % 8 // 1, j, (dx / 14 + j) // 1, k, (dy / 14 + k) // 1
                            cells.setdefault(cell, set()).add(a)
            n = max(map(len, cells.values()), default=0)
            if n >= media.INLIERS:
                out[q, m] = n
    return out


def test_media_copies_are_those_of_all_distances(spark):
    pictures = altered(np.random.default_rng(5), 12)
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in pictures], "id long, picture binary").repartition(3)
    want = exhaustive(pictures)
    got = {(r.query_id, r.match_id): r.inliers for r in media.copies(df).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want) > 50
    assert {(r.query_id, r.match_id): r.inliers for r in media.copies(df, "id % 5 = 0").collect()} == {k: n for k, n in got.items() if k[0] % 5 == 0}


def test_media_hits_travel_as_short_lists():
    """The pairs with HITS hits come out of the lists of two slabs as they went in, from at most three bytes a hit."""
    from collections import Counter

    import pyarrow as pa

    rng = np.random.default_rng(3)
    number = lambda n: rng.integers(0, 3, n) << media.PLACE | rng.integers(0, 40, n)
    entry, key = np.sort(rng.integers(0, 300, 6000)), number(6000)
    more = np.bitwise_or.reduce(1 << rng.integers(0, 56, (6, 6000)), axis=0)
    rows = pa.record_batch([pa.array(entry), pa.array(np.full(6000, -1, np.int32)), pa.array(more), pa.array(key)], ["entry", "part", "more", "picture"])
    want: Counter = Counter()
    for e in range(300):
        at = np.flatnonzero(entry == e).tolist()
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                if key[i] != key[j] and int(more[i] ^ more[j]).bit_count() <= media.NEAR:
                    want[min(key[i], key[j]), max(key[i], key[j])] += 1
    lists: dict = {}
    for b in chain(media._hits(iter([rows.slice(0, 2000), rows.slice(2000)])), media.packed(*np.array([(7, 8), (7, 8), (1, 9)]).T)):
        for x, y, raw in zip(*b.to_pydict().values(), strict=True):
            lists.setdefault((x, y), []).append(raw)
    want.update({(7, 8): 2, (1, 9): 1})
    assert sum(len(r) for raws in lists.values() for r in raws) <= 3 * want.total() and len(lists) == 6
    got = {(x << media.PLACE | a, y << media.PLACE | b) for (x, y), raws in lists.items() for a, b in zip(*(v.tolist() for v in media.unpacked(raws)), strict=True)}
    assert got == {k for k, n in want.items() if n >= media.HITS} and 0 < len(got) < len(want)
    assert not list(media.packed(*np.zeros((2, 0), np.int64)))


def test_media_tables_meet_block_by_block():
    """The hits within a block and between two are those of plain loops, whether keys are split or not."""
    from collections import Counter

    rng = np.random.default_rng(4)

    def table(n, first):
        more = np.bitwise_or.reduce(1 << rng.integers(0, 56, (5, n)), axis=0)
        return media._sorted(rng.integers(0, 200, n) << media._PART, more, (first + rng.integers(0, 5000, n) // 100 * 100).astype(np.int32))

    def loops(one, other=None):
        rows = [list(zip(*(x.tolist() for x in t), strict=True)) for t in (one, other or one)]
        return Counter((min(p, q), max(p, q)) for i, (e, m, p) in enumerate(rows[0]) for f, n, q in rows[1][0 if other else i + 1 :] if e == f and p != q and (m ^ n).bit_count() <= media.NEAR)

    one, other = table(1500, 0), table(900, media.OTHER)
    for crowd in (100, 8, 1):
        held = media.split(one, media.crowded(one, crowd))
        assert (len(held[0]) > len(one[0])) == (crowd < 100)
        for hits, want in ((media._within(held), loops(one)), (media._between(held, other), loops(one, other))):
            got = set(zip(*(x.tolist() for x in media.candidates(hits)), strict=True))
            assert got == {k for k, n in want.items() if n >= media.HITS}
            assert 0 < len(got) < len(want)


def test_media_shuffles_pictures_alone(spark, monkeypatch):
    """What is shuffled are corners, about a KB a picture: no entries (12 KB a picture), no hits. Blocks don't matter."""
    pictures = media.drawn(spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").where("vec_id < 1000"))
    shuffled = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(k) for k in range(s.size())])(spark._jsc.sc().statusStore().executorList(True)))
    before = shuffled()
    whole = sorted(media.joined(pictures).collect())
    assert shuffled() - before < 5_000 * 1000
    monkeypatch.setattr(media, "BLOCK", 90)
    assert sorted(media.joined(pictures).collect()) == whole


def test_media_query_has_every_picture(spark, tmp_path):
    from tessera.llm.queries import op3_media_copies

    some = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").where("vec_id < 402")
    some.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {r.id: r for r in op3_media_copies(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(402))
    right = [r.class_id == i // 4 * 4 if i % 4 < 3 else r.class_id == i for i, r in rows.items()]
    assert sum(right) >= 0.97 * 402 and all(r.class_id // 4 == i // 4 for i, r in rows.items())
    assert all(r.n_links == 0 for i, r in rows.items() if i % 4 == 3)

    twins = media.drawn(some.where("vec_id in (0, 1, 3)")).unionByName(spark.createDataFrame([(None, None), (7, None)], "id long, picture binary"))
    twins = twins.unionByName(twins.select((F.col("id") + 100).alias("id"), "picture")).withColumn("key", F.lit("clash")).withColumn("class_id", F.lit(1))
    again = twins.unionByName(twins.where("id = 3")).unionByName(twins.where("id = 1").withColumn("id", F.lit(0).cast("long")))
    rows = sorted((r.id, r.class_id, r.equal_id, r.members, r.n_links) for r in media.joined(again).collect())
    want = [(0, 0, 0, 2, 1), (0, 0, 0, 3, 1), (1, 0, 0, 3, 1), (3, 3, 3, 3, 0), (3, 3, 3, 3, 0), (7, 7, 7, 1, 0)]
    assert rows == want + [(100, 0, 0, 2, 1), (101, 0, 0, 3, 1), (103, 3, 3, 3, 0), (107, 107, 107, 1, 0)]
    assert media.joined(again.limit(0)).count() == 0


def test_media_pictures_of_any_size(spark):
    whole = media.draw(4, 0, np.zeros(0))
    large = media._resized(whole[None].astype(np.float32), 192)[0].astype(np.uint8)
    wide = np.repeat(whole, 2, axis=1)
    rows = [(1, bytearray(whole.tobytes()), 64), (2, bytearray(large.tobytes()), None), (3, bytearray(wide.tobytes()), 128), (4, bytearray(b"x" * 4095), None), (5, bytearray(), 64)]
    df = spark.createDataFrame(rows, "id long, picture binary, width int")
    assert [(r.id, r.class_id) for r in media.joined(df, width_column="width").orderBy("id").collect()] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
