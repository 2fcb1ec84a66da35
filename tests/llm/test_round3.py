"""Whitening, best-fit packing and vector codes against brute force, on small fixtures."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colophon.llm import bestfit, codes, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, x int, `rows` binary"
NAN, INF = float("nan"), float("inf")


def table_of(spark, rows):
    return spark.createDataFrame([(k, v, label, "extra", 1, b"y") for k, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, non-finite and ragged vectors, repeated rows, equal vectors, a hot label, rows without id or label."""
    random = np.random.default_rng(5)
    x = random.normal(0, 0.3, (700, 10)).round(3)
    rows = [(k, x[k].tolist(), None if k % 3 == 0 else k % 4) for k in range(700)]
    rows += [rows[7], rows[7], (None, x[3].tolist(), 1), (900, x[9].tolist(), 2)]
    rows += [(901, None, 1), (902, [], 1), (903, [0.1] * 9, 1), (904, [None] + [0.1] * 9, 1), (905, [NAN] * 10, 1), (906, [INF] + [0.0] * 9, 1), (907, [-INF] * 10, None)]
    return rows


def usable(rows, d):
    return [(k, np.array(v, np.float32).astype(float), label) for k, v, label in rows if v is not None and len(v) == d and all(e is not None and np.isfinite(e) for e in v)]


# 11 whitening


@pytest.mark.parametrize("d", [1, 2, 5, 40, 200])
def test_largest_pairs(d):
    random = np.random.default_rng(d)
    a = random.normal(0, 30, (3 * d + 5, d)) + random.normal(0, 40, (4, d))[random.integers(0, 4, 3 * d + 5)]
    v = np.atleast_2d(np.cov(a.T))
    values, found = whitening.largest_pairs(lambda x: v @ x, d, 4)
    want, turn = np.linalg.eigh(v)
    k = min(4, d)
    assert np.allclose(values, want[::-1][:k], rtol=1e-13) and found.shape == (d, k)
    assert np.allclose(np.abs((turn[:, ::-1][:, :k] * found).sum(0)), 1, atol=1e-12)
    assert np.linalg.norm(v @ found - found * values, axis=0).max() < 1e-13 * want[-1]


def test_equal_eigenvalues_and_low_rank():
    for v, k in ((np.diag([3.0, 3, 3, 3, 3, 1] + [0.5] * 30), 4), (np.ones((6, 6)), 4), (np.zeros((5, 5)), 4)):
        values, found = whitening.largest_pairs(lambda x: v @ x, len(v), k)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], atol=1e-13) and np.allclose(found.T @ found, np.eye(k), atol=1e-13)


def brute_whitening(rows, d):
    kept = usable(rows, d)
    x = np.floor(256 * np.array([v for _, v, _ in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(fit))
    values, turn = values[::-1][:4], turn[:, ::-1][:, :4]
    return kept, x, fit, (x - fit.mean(0)) @ turn / np.sqrt(values), values / np.trace(centred.T @ centred / len(fit))


def test_whitening(spark, odd):
    kept, x, fit, want, explained = brute_whitening(odd, 10)
    got = whitening.whitened(table_of(spark, odd).repartition(5)).collect()
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {len(fit)} and max(r["identity_error"] for r in got) < 1e-12
    sums = fit.sum(0)
    by = {k: (w, int(((len(fit) * v - sums) ** 2).sum())) for (k, _, _), w, v in zip(kept, want, x)}
    sign = {}
    for r in got:
        w, deviation = by[r["vec_id"]]
        c = r["component"]
        if abs(w[c - 1]) > 1e-6:
            assert sign.setdefault(c, np.sign(w[c - 1] * r["whitened"])) == np.sign(w[c - 1] * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(w[c - 1])) < 1e-9 and r["deviation"] == deviation and abs(r["explained"] - explained[c - 1]) < 1e-12
    assert queries.QUERIES["op11_whitening"](spark, SF).count() == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").filter("embedding is not null").count()


def test_whitening_of_little(spark):
    empty = table_of(spark, [])
    assert whitening.whitened(empty).count() == 0 and "identity_error" in whitening.whitened(empty).columns
    assert whitening.whitened(table_of(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    assert whitening.whitened(table_of(spark, [(k, [0.5, 0.25], 1) for k in range(5)])).count() == 0  # no variance
    two = whitening.whitened(table_of(spark, [(1, [0.5, 0.25, 0.0], 1), (2, [0.25, 0.5, 0.0], 1)])).collect()
    assert [(r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two] == [(1, 1.0, 1.0)] * 2
    # sums that leave the longs are exact, a deviation that does is null
    huge = whitening.whitened(table_of(spark, [(1, [1e30, 0.5], 1), (2, [-1e30, 0.25], 1), (3, [0.0, 0.0], 1)])).collect()
    assert len(huge) >= 3 and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)


def test_added_is_the_sum_over_tasks(spark):
    rows = spark.range(1000).repartition(13)
    def partial(batches):
        for b in batches:
            x = b.column("id").to_numpy()
            yield [np.array([x.sum()]), np.array([[x.sum() / 2, len(x)]], float)]
    whole, parts = vectors.added(rows, partial)
    assert whole.tolist() == [499500] and parts.tolist() == [[249750.0, 1000.0]]
    assert vectors.added(rows.filter("id < 0"), partial) is None


# 12 best-fit packing


def bins_of(kinds):
    return sum(kinds.values())


def test_exchanges_empty_bins():
    histogram = np.zeros(11, np.int64)
    for n, k in ((6, 2), (5, 1), (4, 1), (3, 1), (2, 1), (7, 1)):
        histogram[n] += k
    # a start in which each bin holds what came next, 6+3, 6+2, 5+4, 7
    start = {((6, 1), (3, 1)): 1, ((6, 1), (2, 1)): 1, ((5, 1), (4, 1)): 1, ((7, 1),): 1}
    out = bestfit.exchanged(start, 10)
    assert sum((bestfit.fill(k) ** 2) * n for k, n in out.items()) > sum((bestfit.fill(k) ** 2) * n for k, n in start.items())
    assert bins_of(out) <= 4 and held(out, 10).tolist() == histogram.tolist()
    assert bins_of(bestfit.exchanged({((3, 1),): 2, ((4, 1),): 1}, 10)) == 1


def held(kinds, window):
    out = np.zeros(window + 1, np.int64)
    for kind, bins in kinds.items():
        assert bins > 0 and bestfit.fill(kind) <= window
        for n, k in kind:
            out[n] += k * bins
    return out


def first_fit(histogram):
    room = []
    for n in range(len(histogram) - 1, 0, -1):
        for _ in range(histogram[n]):
            fits = [k for k, r in enumerate(room) if r >= n]
            if fits:
                best = min(fits, key=lambda k: room[k])
                room[best] -= n
            else:
                room.append(len(histogram) - 1 - n)
    return len(room)


def test_solver_holds_all_and_is_no_worse_than_best_fit():
    random = np.random.default_rng(3)
    for _ in range(60):
        window = int(random.integers(3, 60))
        histogram = np.bincount(random.integers(1, window + 1, int(random.integers(0, 120))), minlength=window + 1).astype(np.int64)
        start = bestfit.best_fit(histogram)
        out = bestfit.solve(histogram)
        assert held(start, window).tolist() == held(out, window).tolist() == histogram.tolist()
        assert -(-int((histogram * np.arange(window + 1)).sum()) // window) <= bins_of(out) <= bins_of(start) == first_fit(histogram)


def test_best_fit_pieces(spark):
    long = "the cat sat on a mat and then it ran off. " * 900
    texts = [None, "", " \n ", "one two", "été à la plage", long, long + "x", "same here", "same here", "日本語 テスト", "<|endoftext|> a"] + ["w " * k for k in range(1, 60)]
    rows = [(k if k != 3 else None, t, f"f{k}", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[7]], "doc_id bigint, text string, first string, place int").repartition(5)
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for k, t, *_ in rows + [rows[7]]:
        want[k].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    got = bestfit.packed_whole(docs, PATH, 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        ids = want[k][0]
        assert len(pieces) == len(want[k]) * -(-len(ids) // 64)
        for r in pieces:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"]
            assert r["length"] == 64 if r["piece"] else r["start"] == 0 and r["length"] == (len(ids) - 1) % 64 + 1
        assert sorted(r["piece"] for r in pieces) == sorted(p for ids in want[k] for p in range(-(-len(ids) // 64)))
    for parts in by_sequence.values():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert bestfit.packed_whole(docs.limit(0), PATH).count() == 0


# 13 vector codes


def brute_codes(rows, d):
    kept = sorted(usable(rows, d), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    wide = -(-d // 4) * 4
    x = np.zeros((len(kept), wide), np.int64)
    x[:, :d] = np.floor(1024 * np.array([v for _, v, _ in kept]))
    parts = x.reshape(len(kept), 4, -1)
    books = parts[:256].swapaxes(0, 1).copy()

    def assign():
        apart = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)
        return apart.argmin(2), apart.min(2)

    for _ in range(4):
        code, _ = assign()
        for p in range(4):
            for e in range(books.shape[1]):
                mine = parts[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code, error = assign()
    total = error.sum(1)
    labels = defaultdict(int)
    for (_, _, label), e in zip(kept, total):
        labels[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((k, "".join(f"{c:02x}" for c in cs), int(e), labels[label], sha) for (k, _, label), cs, e in zip(kept, code, total)), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_vector_codes(spark, odd):
    assert plain(codes.compressed(table_of(spark, odd).repartition(5))) == brute_codes(odd, 10)
    few = odd[:20]
    assert plain(codes.compressed(table_of(spark, few))) == brute_codes(few, 10)
    same = [(k, [0.25, -0.5, 0.125, 0.75], None) for k in range(9)]
    assert plain(codes.compressed(table_of(spark, same))) == brute_codes(same, 4)
    assert codes.compressed(table_of(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compressed(table_of(spark, [(1, None, 1)])).count() == 0


def test_vector_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert plain(queries.QUERIES["op13_vector_codes"](spark, SF)) == brute_codes(rows, 64)


def test_masks_are_exact():
    random = np.random.default_rng(2)
    for n, d, scale in ((256, 3, 50), (70, 5, 4), (1, 2, 9), (130, 4, 100_000)):
        entries, x = random.integers(-scale, scale, (n, d)), random.integers(-2 * scale, 2 * scale, (500, d))
        book = codes.Codebook(entries)
        radius = random.integers(0, scale, 500)
        masks = np.unpackbits(book.candidates(x, radius).view(np.uint8), axis=1, bitorder="little")[:, :n]
        assert (masks == (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(2)).all()
        apart = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, error = book.nearest(x)
        assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all()
    huge = codes.Codebook(np.array([[2**62, 0], [-(2**62), 1]]))
    assert [y.tolist() for y in huge.nearest(np.array([[2**62 - 5, 3], [0, 0]]))] == [[0, 0], [34, 2**63 - 1]]
