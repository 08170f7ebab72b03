"""Each operator on rows with nulls, empties, ties and copies, against brute force."""

import base64
import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bloom_lookup, components, mil_quality, packing, pivotal_mix, pu_toxicity, secret_ledger, simhash, substring_dedup, tiff_pages, url_filter
from loomgraph.llm.common import LAST_ID, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def ids_of(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


# substring dedup


def brute_repeats(data, length=20):
    """(id, text): words, kept words, by first occurrence; rows without id come last, by MD5."""
    first, expected = {}, {}
    unique = sorted({(LAST_ID if i is None else i, i is None, hashlib.md5((t or "").encode()).digest(), i, t or "") for i, t in data})
    for *_, i, t in unique:
        w = WORD.findall(t)
        gone = set()
        for a in range(len(w) - length + 1):
            if first.setdefault(tuple(w[a : a + length]), (i, t, a)) != (i, t, a):
                gone |= set(range(a, a + length))
        expected[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return expected


def check_repeats(df, data, length=20):
    expected = brute_repeats(data, length)
    got = substring_dedup.remove_repeats(df, length).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter((i, *expected[i, t or ""]) for i, t in data)
    texts = defaultdict(set)
    for i, t in data:
        texts[i].add(tuple(WORD.findall(t or "")))
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) >= r.n_removed and all(s.end - s.start >= length for s in r.repeats)
        for s in r.repeats:  # each repeat is there, in an earlier place
            n = s.end - s.start
            assert any(w[s.start : s.end] == v[s.of_start : s.of_start + n] for w in texts[r.doc_id] for v in texts[s.of])
            assert s.of is None or r.doc_id is None or (s.of, s.of_start) < (r.doc_id, s.start)
    return got


def test_repeats_equal_brute_force(docs, data, no_docs):
    check_repeats(docs, [(i, t) for i, t, _ in data])
    assert substring_dedup.remove_repeats(no_docs, 20).count() == 0


def test_repeats_of_rows_without_an_id_of_their_own(spark):
    """Null ids, the greatest id, and ids given to several texts are never taken for one another."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(30))
    own = lambda k: " ".join(f"u{k}x{j}" for j in rng.integers(0, 1000, 60))
    rows = [(1, passage)] + [(None, passage)] * 20 + [(None, own(k)) for k in range(300)] + [(LAST_ID, own(400)), (LAST_ID, f"{own(401)} {passage}"), (7, own(402)), (7, f"{own(403)} {passage} {own(404)}"), (7, passage)]
    rows += [(None, f"{own(k)} {passage} {own(k)}") for k in range(500, 520)] + [(8, rows[25][1]), (None, rows[26][1])]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_an_anchor_with_many_extensions(spark):
    """A common phrase in different contexts, some of which repeat, over several batches."""
    rng = np.random.default_rng(6)
    phrase = " ".join(f"c{k}" for k in range(9))
    context = lambda n, of: " ".join(f"v{k}" for k in rng.integers(0, of, n))
    pool = [f"{context(12, 10**6)} {phrase} {context(12, 10**6)}" for _ in range(30)]
    rows = [(k, f"{context(5, 10**6)} {pool[rng.integers(30)] if k % 3 == 0 else context(14, 10**6) + ' ' + phrase + ' ' + context(14, 10**6)} {context(5, 10**6)}") for k in range(400)]
    rows += [(1000, f"{phrase} {phrase} {phrase} {phrase}"), (1001, pool[0]), (1002, f"x {pool[1]} y {pool[1]} z")]
    got = check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    whole = next(r for r in got if r.doc_id == 1002)
    assert max(s.end - s.start for s in whole.repeats) == 33


def test_long_windows_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    shared = [f"w{k}" for k in rng.integers(0, 5000, 2500)]
    own = lambda k, n: [f"d{k}x{j}" for j in range(n)]
    texts = [own(0, 40) + shared, shared[100:2000] + own(1, 700), own(2, 300) + shared[700:1290] + own(3, 30) + shared[50:900], ["x"] * 1500, own(4, 200) + ["x"] * 900]
    for length in (264, 600):
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), length).collect()}
        first, marked = {}, 0
        for k, words in enumerate(texts):
            gone = set()
            for a in range(len(words) - length + 1):
                if first.setdefault(tuple(words[a : a + length]), (k, a)) != (k, a):
                    gone |= set(range(a, a + length))
            marked += len(gone)
            assert (got[k].n_words, got[k].n_removed) == (len(words), len(gone)), (length, k)
            assert got[k].kept == " ".join(w for j, w in enumerate(words) if j not in gone)
        assert marked > 4000


def test_hot_passage_and_periodic_texts(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(60)] + [(100, "x " * 500), (101, "x y " * 100), (102, "y x " * 100)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got[0].n_removed == 0 and all(got[k].kept == f"a{k} b{k} c{k}" for k in range(1, 60))
    assert got[100].n_removed == 499 and got[101].n_removed == 198 and got[102].n_removed == 200


# near-duplicates


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    fps = [fp for _, fp in pairs]
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                group[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        least[find(k)].append(i)
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(pairs))]


def test_near_duplicates(docs, data, no_docs):
    got = simhash.near_duplicates(docs).collect()
    pairs = [(i, fingerprint(t)) for i, t, _ in data]
    expected = Counter((i, fp, c) for (i, fp), c in zip(pairs, brute_components(pairs)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_first(docs, data, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    pairs = [(i, fingerprint(t)) for i, t, _ in data]
    assert ids_of(kept) == Counter({c: 1 for c in brute_components(pairs)})
    assert simhash.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("center,most", [(0, 20_000), (0x0123456789ABCDEF, 50)])
def test_links_of_a_dense_ball(spark, center, most):
    """All fingerprints within two bits of one, chains, and strays: the components equal brute force."""
    rng = np.random.default_rng(3)
    fps = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | set(rng.integers(0, 1 << 63, 200).tolist())
    chain = 0x7777777777777777
    for k in range(0, 40, 4):
        chain ^= 0xF << k
        fps.add(chain)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    assert found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    roots = {r.node: r.root for r in components.components(found).collect()}
    pairs = [(x, x % (1 << 64)) for x in signed]
    assert [roots.get(x, x) for x in signed] == brute_components(pairs)


def test_pivots_discard_strangers_and_no_link(spark):
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 1 << 64, 3000, np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, (3000, 4), np.uint64)).T.copy().view(np.uint64)[0] ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64))
    rows = simhash.with_pivots(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 32).collect()
    table = {r.fp: np.frombuffer(r.distances, np.int8) for r in rows}
    assert all(table[int(np.int64(x.view(np.int64)))].tolist() == [(int(x) ^ int(p)).bit_count() for p in simhash.pivots(32)] for x in fps[:50])
    both = np.concatenate((simhash.pivot_table(fps, simhash.pivots(32)), simhash.pivot_table(near, simhash.pivots(32))))
    assert len(simhash.survivors(both, np.arange(3000), 3000 + np.arange(3000), 4)) == 3000
    i, j = np.triu_indices(3000, 1)
    assert len(simhash.survivors(both, i, j, 4)) < 10  # of 4.5 million pairs


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(6, 60)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")).collect()}
    assert roots == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 60)}


# mixing


def filled(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        rate, left = left / sum(w[s] for s in open_), 0
        for s in list(open_):
            target[s] += rate * w[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_mix(docs, data, no_docs):
    got = pivotal_mix.mix(pivotal_mix.sizes(docs)).collect()
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    expected = filled(sizes, (5, 2, 1), 1.5, 2)
    taken = defaultdict(int)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in data)
    for r in got:
        assert abs(r.target - expected[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(r.size for r in got if r.source == s)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pivotal_mix.mix(pivotal_mix.sizes(docs)).collect()), key=str)
    assert pivotal_mix.mix(pivotal_mix.sizes(no_docs)).count() == 0
    rows = pivotal_mix.mixed_rows(docs)
    assert rows.columns == docs.columns and pivotal_mix.mixed_rows(no_docs).count() == 0
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert ids_of(rows) == Counter({k: v for k, v in copies.items() if v})


def test_mix_of_many(spark):
    """Several levels of the tree, unbiased and on target."""
    items = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "1 + id * 7919 % 50 as size")
    got = pivotal_mix.mix(items, weights=(1, 1), share=0.5)
    sums = got.groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("copies").alias("c"), F.avg("copies").alias("m"), F.max("source_size").alias("s")).collect()
    for r in sums:
        assert abs(r.t - r.target) <= 50 and r.c == 1 and abs(r.m - r.target / r.s) < 0.05


def test_repeated_rows_share_their_copies(spark):
    items = spark.createDataFrame([(1, "a", 10)] * 5 + [(2, "b", 100)], "doc_id long, source string, size long")
    got = pivotal_mix.mix(items, weights=(1, 1), share=0.5).where("doc_id = 1").collect()
    assert sum(r.copies for r in got) in (2, 3, 4, 5) and max(r.copies for r in got) - min(r.copies for r in got) <= 1


# packing


def test_packing(docs, data, no_docs):
    got = packing.pack_documents(docs, VOCABULARY, 256).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for i, t, _ in data:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected.update((i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(placed) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_best_fit():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 101, 500), rng.integers(34, 101, 300), np.full(7, 34), np.array([100]), np.empty(0, int)):
        sequence, offset = packing.best_fit(lengths, 100)
        for s in np.unique(sequence):
            mine = np.flatnonzero(sequence == s)
            assert lengths[mine].sum() <= 100 and (3 * lengths[mine] > 100).sum() <= 2
            order = mine[np.argsort(offset[mine])]
            assert (offset[order] == np.concatenate(([0], np.cumsum(lengths[order])[:-1]))).all()


def test_packed_tokens_come_back(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    found = packing.pieces(docs, VOCABULARY, 64, 1, with_ids=True).persist()
    rows = packing.sequences(packing.pack(found, 64)).collect()
    ids = sorted(x for r in found.collect() for x in r.ids)
    assert sorted(x for r in rows for x in r.ids) == ids and len(rows) == 1


@pytest.mark.parametrize("text", ["It's <|endoftext|> a", "ÀÉß Été, x.. a., 1. é. ¿Qué, É", "Σας é ́x don't'S q\u0085z", "ﬁ İ ǅ 𝒳 中文 字 12345", "", " \n"])
def test_word_tokens_equal_the_whole_text(text):
    words = packing.WordTokens(VOCABULARY)
    assert words.of(text.encode()) == words.whole(text)


# media


@pytest.mark.parametrize("codec", [tiff_pages.NONE, tiff_pages.PACKBITS, tiff_pages.LZW, tiff_pages.DEFLATE])
def test_codecs_round_trip(codec):
    rng = np.random.default_rng(4)
    images = [(rng.integers(0, 256, 64 * 90).astype(np.uint8).tobytes(), 64), (bytes(64 * 1000), 64), (b"ab" * 320 * 60, 640), (rng.integers(0, 3, 64 * 700).astype(np.uint8).tobytes(), 64)]
    images.append((rng.integers(97, 123, 50 * 333).astype(np.uint8).tobytes(), 50))
    for predictor, tile in ((1, 0), (2, 0), (1, 16), (2, 48)):
        found = tiff_pages.read(tiff_pages.encode(images, codec, predictor, strip_bytes=4096, tile=tile))
        assert [(p.pixels, p.width, p.error) for p in found] == [(*x, None) for x in images]


def big_endian_tiles() -> tuple[bytes, np.ndarray]:
    """A 20 by 18 image of 16-bit samples in four deflated 16 by 16 tiles, with the predictor."""
    import struct

    image = (np.arange(360).reshape(18, 20) * 977 % 65536).astype(np.uint16)
    out, at, size = bytearray(b"MM\0*\0\0\0\0"), [], []
    for r in (0, 16):
        for c in (0, 16):
            tile = np.zeros((16, 16), np.uint16)
            part = image[r : r + 16, c : c + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            tile[:, 1:] -= tile[:, :-1].copy()
            data = zlib.compress(tile.astype(">u2").tobytes())
            at.append(len(out))
            size.append(len(data))
            out += data
    lists = {}
    for name, values in (("at", at), ("size", size)):
        lists[name] = len(out)
        out += struct.pack(">4I", *values)
    struct.pack_into(">I", out, 4, len(out))
    short = lambda v: struct.pack(">HH", v, 0)
    entries = [(256, 3, 1, short(20)), (257, 3, 1, short(18)), (258, 3, 1, short(16)), (259, 3, 1, short(8)), (317, 3, 1, short(2)), (322, 3, 1, short(16)), (323, 3, 1, short(16)), (324, 4, 4, struct.pack(">I", lists["at"])), (325, 4, 4, struct.pack(">I", lists["size"]))]
    out += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", *e[:3]) + e[3] for e in entries) + b"\0\0\0\0"
    return bytes(out), image


def test_tiles_and_byte_order():
    data, image = big_endian_tiles()
    (page,) = tiff_pages.read(data)
    assert page.error is None and page.pixels == image.astype(">u2").tobytes()


def one_strip(order: str, width: int, height: int, samples: int, bits: int, predictor: int, strip: bytes) -> bytes:
    import struct

    tags = [(256, width), (257, height), (258, bits), (259, 1), (273, 8), (277, samples), (278, height), (279, len(strip)), (317, predictor)]
    directory = struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(f"{order}HHII", tag, 4, 1, value) for tag, value in tags) + bytes(4)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8 + len(strip)) + strip + directory


@pytest.mark.parametrize("order", ["<", ">"])
def test_every_predictor(order):
    width, height, rng = 7, 5, np.random.default_rng(6)
    for samples in (1, 3):
        for bits in (4, 8, 12, 16, 24, 32, 64):
            values = [[[int(rng.integers(0, 1 << min(bits, 62))) for _ in range(samples)] for _ in range(width)] for _ in range(height)]
            less = [[[(v - (row[x - 1][s] if x else 0)) % (1 << bits) for s, v in enumerate(cell)] for x, cell in enumerate(row)] for row in values]

            def stored(grid, bits=bits):
                flat = [[v for cell in row for v in cell] for row in grid]
                if bits % 8 == 0:
                    return b"".join(v.to_bytes(bits // 8, "little" if order == "<" else "big") for row in flat for v in row)
                whole = ["".join(f"{v:0{bits}b}" for v in row) for row in flat]
                return b"".join(int(b + "0" * (-len(b) % 8), 2).to_bytes(-(-len(b) // 8), "big") for b in whole)

            (page,) = tiff_pages.read(one_strip(order, width, height, samples, bits, 2, stored(less)))
            assert (page.error, page.pixels) == (None, stored(values)), (samples, bits)
        for bits in (16, 32, 64):
            image = rng.normal(size=(height, width * samples)).astype(f"{order}f{bits // 8}")
            strip = b""
            for row in image:
                high_first = row.astype(f">f{bits // 8}").tobytes()
                planes = b"".join(high_first[k :: bits // 8] for k in range(bits // 8))
                strip += bytes((b - (planes[k - samples] if k >= samples else 0)) % 256 for k, b in enumerate(planes))
            (page,) = tiff_pages.read(one_strip(order, width, height, samples, bits, 3, strip))
            assert (page.error, page.pixels) == (None, image.tobytes()), (samples, bits)


def test_broken_files_never_raise():
    """Every truncation, every byte changed, odd values of every tag: pages or errors, never an exception."""
    import struct

    rng = np.random.default_rng(9)
    for codec, tile in ((tiff_pages.PACKBITS, 0), (tiff_pages.LZW, 16), (tiff_pages.DEFLATE, 16)):
        good = tiff_pages.encode([(rng.integers(0, 4, 64 * 20).astype(np.uint8).tobytes(), 64), (b"y" * 64, 64)], codec, tile=tile)
        for n in range(len(good)):
            assert tiff_pages.read(good[:n])
        for at in range(len(good)):
            for value in (0, 1, 255, int(rng.integers(256))):
                assert tiff_pages.read(good[:at] + bytes((value,)) + good[at + 1 :])
        # entries of the first directory: tag, type, count, value
        (first,) = struct.unpack_from("<I", good, 4)
        for k in range(struct.unpack_from("<H", good, first)[0]):
            place = first + 2 + 12 * k
            for field, code, values in ((2, "H", (0, 1, 3, 99)), (4, "I", (0, 2, 1 << 31)), (8, "I", (0, 2, 7, 65, 1 << 16, (1 << 32) - 1))):
                for value in values:
                    odd = bytearray(good)
                    struct.pack_into(f"<{code}", odd, place + field, value)
                    pages = tiff_pages.read(bytes(odd))
                    assert pages and all((p.pixels is None) == (p.error is not None) for p in pages)


def test_a_page_too_large_for_its_bytes_is_refused():
    (page,) = tiff_pages.read(one_strip("<", 40_000, 40_000, 1, 8, 1, b"x" * 10))
    assert page.pixels is None and "larger" in page.error


def test_features_of_broken_pages_and_clashing_names(spark):
    good = tiff_pages.encode([(b"x" * 128, 64)])
    files = spark.createDataFrame([(1, good, "a"), (2, None, "b"), (3, good[:-20], "c"), (3, one_strip("<", 7, 3, 3, 4, 1, bytes(33)), "d")], "page int, content binary, error string")
    got = {r.file_error: r for r in tiff_pages.features(tiff_pages.pages(files, keep=("page", "error"))).collect()}
    assert got["a"].feature and got["a"].file_page == 1 and got["a"].page == 0
    assert got["b"].feature is None and got["c"].feature is None and got["c"].error and got["d"].feature


def test_stored_texts_meet_every_form(spark, sf_dir):
    """op1's columns against plain Python; all codecs, strips, tiles and second pages occur in short and long texts."""
    from loomgraph.llm import queries

    got = {r.doc_id: r for r in queries.op1_tiff_pages(spark, sf_dir).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    forms = {False: set(), True: set()}
    for i, text in texts.items():
        padded, r = text + bytes(-len(text) % 64 or 64 * (not text)), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = tiff_pages._stored(text)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        pages = tiff_pages.read(media)
        forms[len(text) > 2000].add((pages[0].compression, tiff_pages.TILE_AT in pages[0].tags, len(pages)))
    assert len(forms[False]) == len(forms[True]) == 12


def test_pages_of_broken_files(spark):
    good = tiff_pages.encode([(b"x" * 128, 64), (b"y" * 64, 64)])
    loop = bytearray(good)
    rows = [(1, good), (2, None), (3, b""), (4, b"not a tiff"), (5, good[:40]), (6, bytes(loop)), (6, bytes(loop))]
    found = tiff_pages.pages(spark.createDataFrame(rows, "id long, content binary"), keep=("id",)).collect()
    by = defaultdict(list)
    for r in found:
        by[r.id].append((r.page, r.error))
    assert by[1] == [(0, None), (1, None)] and len(by[6]) == 4
    assert by[2] == by[3] == [(-1, "no bytes")] and by[4] == [(-1, "not a TIFF file")] and by[5][-1][1]
    assert tiff_pages.pages(spark.createDataFrame([], "id long, content binary"), keep=("id",)).count() == 0


def test_texts_as_media(docs, data, no_docs):
    found = tiff_pages.features(tiff_pages.pages(tiff_pages.from_texts(docs), keep=("doc_id", "n_bytes")).where("page = 0")).collect()
    pad = lambda t: t + bytes(-len(t) % 64 or 64 * (not t))
    assert Counter((r.doc_id, bytes(r.pixels)) for r in found) == Counter((i, pad((t or "").encode())) for i, t, _ in data)
    assert len({(bytes(r.pixels), r.feature) for r in found}) == len({bytes(r.pixels) for r in found})
    assert tiff_pages.features(tiff_pages.pages(tiff_pages.from_texts(no_docs), keep=("doc_id",))).count() == 0


# secrets


def spans_of(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def versions(docs):
    return docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))


def test_ledger_scans_a_blob_once(spark, docs, data, no_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    got = secret_ledger.findings(versions(docs), ledger).collect()
    assert Counter((r.path, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in got) == Counter((i, tuple(spans_of(t or ""))) for i, t, _ in data)
    blobs = len({hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in data})
    assert secret_ledger.read_ledger(spark, ledger).count() == blobs
    new = spark.createDataFrame([(99, 1, "api_key: Zyxwvu99")], "path long, version int, content string")
    again = secret_ledger.findings(versions(docs).unionByName(new), ledger).where("path = 99").collect()
    assert [tuple(s) for s in again[0].spans] == [("assign", 0, 17)]
    assert secret_ledger.read_ledger(spark, ledger).count() == blobs + 1
    secret_ledger.findings(versions(docs), ledger, "2").count()
    assert secret_ledger.read_ledger(spark, ledger).count() == 2 * blobs + 1
    assert secret_ledger.findings(versions(no_docs), str(tmp_path / "none")).count() == 0


def test_a_ledger_with_a_pair_twice(spark, tmp_path):
    """Two writers at once; no row doubles, and nothing is scanned anew."""
    ledger = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(None, 0, "token=abcdef99 é"), (1, 0, None), (1, 1, "plain"), (1, 1, "plain")], "path long, version int, content string")
    secret_ledger.update(rows, ledger)
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger + "-copy").write.mode("append").parquet(ledger)
    before = secret_ledger.read_ledger(spark, ledger).count()
    got = secret_ledger.findings(rows, ledger)
    assert sorted((r.path or 0, r.version, len(r.spans)) for r in got.collect()) == [(0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 0)]
    assert secret_ledger.read_ledger(spark, ledger).count() == before == 6


def test_scans_take_time_in_proportion():
    import time

    for part in (b"eyJ", b"a", b"token ", b"-----BEGIN A ", b"xox", b"xoxb-", b"a://b:", b"0a", "é=".encode(), b"AKIA", b"ghp_", b"secret = "):
        began = time.time()
        secret_ledger.scan(part * (3_000_000 // len(part)) + b"://")
        assert time.time() - began < 5, part
    many = "é token=abcdef9 " * 100_000
    assert secret_ledger.scan(many.encode())[-1] == (99_999 * 16 + 2, 0, 99_999 * 16 + 15)


def test_user_info_equals_a_plain_pattern():
    rng = np.random.default_rng(3)
    plain = re.compile(r"[a-z][a-z0-9+.-]*://[^\x00-\x20/@:]+:[^\x00-\x20/@]+@")
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Z", "1", "+", "://", ":", "@", "/", " ", "é"], 30, p=[0.2, 0.05, 0.1, 0.05, 0.2, 0.15, 0.15, 0.03, 0.04, 0.03]))
        got = [(a, b) for a, k, b in secret_ledger.scan(text.encode()) if secret_ledger.KINDS[k] == "userinfo"]
        assert got == [m.span() for m in plain.finditer(text)], text


def test_mask(docs, no_docs, tmp_path):
    got = secret_ledger.mask(docs, str(tmp_path / "a"))
    assert got.columns == docs.columns and ids_of(got) == ids_of(docs)
    row = got.where("doc_id = 18").first()
    assert row.text == "é [SECRET]\" [SECRET] [SECRET]" and row.n_chars == len(row.text)
    assert got.where("doc_id != 18").select("doc_id", "text").exceptAll(docs.where("doc_id != 18").select("doc_id", "text")).count() == 0
    assert secret_ledger.mask(no_docs, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("text,kinds", [("PASSWORD='short'", []), ("passſword: abcdefg", []), ("secret=abcdef", ["assign"]), ("ghp_" + "Z" * 36, ["github"]), ("xAKIA" + "B" * 16, ["access"]), ("0" * 23, []), ("a://me:pw@h", ["userinfo"])])
def test_kinds(text, kinds):
    assert [secret_ledger.KINDS[k] for _, k, _ in secret_ledger.scan(text.encode())] == kinds


# URLs

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "/x", "block"), ("a.b", "/x", "block"), ("b", "", "allow")]


def judged(url):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)] if at >= 0 else []
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    urls = ["http://x.example.net/en/1?q", "HTTPS://X.Example.NET/de/", "http://net/", "http://net", "https://sub.org/fr/a#b", "http://fakenet/", "ftp://example.com/de/x", "http://a.b/xyz/", "http://q.a.b/", "", None, "no scheme", "http://", "http://a.b?x://y", "http://É.net/ü"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[2])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert Counter(map(tuple, got.collect())) == Counter((k, *judged(u)) for k, u in rows)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_urls_of_any_length(spark):
    """Long paths and hosts cost no more than their length, and many rule shapes hold."""
    import time

    rules = [*RULES, *(("net", "/" + "x" * n, "block" if n % 2 else "allow") for n in range(1, 2500)), ("1.0.9.8", "", "block"), (None, "/", "block"), ("a", None, "block")]
    urls = ["http://net/" + "a/" * 100_000, "http://" + "a." * 1000 + "net/q", "http://net/" + "x" * 2600, "http://net/" + "x" * 77 + "?x", "http://9.1.0.9.8"]
    frame = spark.createDataFrame([(k, u, 1, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule int, host string")
    began = time.time()
    got = {r.page_id: r for r in url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert time.time() - began < 60
    assert [(r.rule and len(r.rule), r.verdict) for _, r in sorted(got.items())] == [(4, "block"), (4, "block"), (2503, "block"), (81, "block"), (7, "block")]
    assert got[0].path == "/" + "a/" * 100_000 and got[1].host == "a." * 1000 + "net"


# sketches


def digest_set(text):
    keys, count, out = bloom_lookup.paragraphs(text.encode()).tolist(), Counter(), set()
    for k in keys:
        out.add((k, count[k]))
        count[k] += 1
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_recover_all_differences(spark, docs, no_docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in bloom_lookup.fingerprint_edits(plain).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in plain.collect())
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        edit = text[: n - n // 4] + after[: n // 4]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(digest_set(text), digest_set(edit))) < 1e-12
        assert abs(r.near_next - jaccard(digest_set(text), digest_set(after))) < 1e-12
    assert got[4].fingerprint == got[10].fingerprint != got[5].fingerprint
    assert ids_of(bloom_lookup.fingerprint_edits(docs)) == ids_of(docs)
    assert bloom_lookup.fingerprint_edits(no_docs).count() == 0
    (one,) = bloom_lookup.fingerprint_edits(docs.where("doc_id = 1")).collect()
    assert one.near_next == 1.0


def plain_sketch(text, width):
    """The sketch of a text by its definition, one digest at a time."""
    cells, count = np.zeros((3, width), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")]), Counter()
    with np.errstate(over="ignore"):
        for k in bloom_lookup.paragraphs(text.encode()):
            key = mixed(k + np.uint64(count[int(k)]) * bloom_lookup._SALTS[0])
            count[int(k)] += 1
            for t, salt in enumerate(bloom_lookup._SALTS):
                c = cells[t, int(mixed(key ^ salt)) % width]
                c["count"] += 1
                c["key"] ^= key
                c["check"] ^= bloom_lookup.Cells.checks(key).astype(np.uint32)
    return base64.b64encode(cells.tobytes()).decode()


def test_fingerprints_alone_give_the_likeness(spark, docs):
    """Each fingerprint is the sketch it should be, and most edits are told from the two fingerprints only."""
    rows = bloom_lookup.fingerprint_edits(docs).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    alone = 0
    for r in rows:
        sizes = {len(bloom_lookup.paragraphs(t.encode())): t for t in texts[r.doc_id]}
        assert r.fingerprint in {plain_sketch(t, int(bloom_lookup.widths(np.array([n]))[0])) for n, t in sizes.items()}
        found = bloom_lookup.subtract(r.fingerprint, r.edited_fingerprint)
        if found is not None:
            alone += 1
            assert sorted(found[0].view(np.int64).tolist()) == sorted(r.gone) and sorted(found[1].view(np.int64).tolist()) == sorted(r.come)
            n = sum(bloom_lookup.Cells.of_string(r.fingerprint).count) // 3
            assert r.near_edited == (1.0 if not n + len(r.come) else (n - len(r.gone)) / (n + len(r.come)))
    assert alone >= 0.9 * len(rows)


def test_next_documents_where_ids_are_equal_or_missing(spark):
    """Very many rows without id are dealt over several ranges, in the order of their hashes."""
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(40)) if k % 4 == 0 else None if k % 4 < 3 else 17, " ".join(f"w{x}" for x in rng.integers(0, 50, 30))) for k in range(400)] + [(3, None), (None, None), (LAST_ID, "x y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = frame.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("key"), F.xxhash64("text").alias("hash"), "doc_id", "text").collect()
    ordered = sorted(keyed, key=lambda r: (r.key, r.hash))
    expected = Counter()
    for r, after in zip(ordered, ordered[1:] + ordered[:1]):
        edit = bloom_lookup.edited(r.text or "", after.text or "")
        expected[r.doc_id, len(r.text or ""), hashlib.sha256(edit.encode()).hexdigest(), round(jaccard(digest_set(r.text or ""), digest_set(after.text or "")), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in bloom_lookup.fingerprint_edits(frame).collect()) == expected


# classifiers


@pytest.fixture(scope="module")
def corpus(spark):
    """600 documents; every third is toxic (one of three words) and every fourth of low quality (symbols)."""
    rng = np.random.default_rng(8)
    plain = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(600):
        w = rng.choice(plain, 80).tolist()
        toxic, low = k % 3 == 0, k % 4 == 1
        if toxic:
            for at in rng.integers(0, 80, 4):
                w[at] = str(rng.choice(["nasty", "vile,", "Gross"]))
        if low:
            w = [x + "$$$" for x in w]
        texts.append((k, " ".join(w)))
        labels.append((k, int(not low), int(toxic)) if k % 2 == 0 or k % 5 == 1 else (k, None, None))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(corpus, docs, no_docs):
    texts, labels = corpus
    model = pu_toxicity.train(texts, labels)
    got = pu_toxicity.score(texts, model).where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = pu_toxicity.clean(texts, model)
    assert kept.count() == pu_toxicity.score(texts, model).where("predicted = 0").count()
    again = pu_toxicity.train(texts, labels)
    assert again.weights == model.weights
    assert ids_of(pu_toxicity.score(docs, model)) == ids_of(docs) and pu_toxicity.score(no_docs, model).count() == 0
    none = pu_toxicity.train(texts, labels.where("false"))
    assert pu_toxicity.score(docs, none).where("predicted = 1").count() == 0
    pu_toxicity.train(no_docs, labels)


def test_toxicity_scores_and_risk_by_their_definitions(corpus):
    """Scores from the features one by one; the slope against differences of the non-negative risk."""
    texts, labels = corpus
    model = pu_toxicity.train(texts, labels)
    for r in pu_toxicity.score(texts, model).join(texts, "doc_id").limit(100).collect():
        found = {"".join(c for c in w if c not in string.punctuation) for w in r.text.lower().split()} - {""}
        stems = Counter(w[:n] for w in found for n in (5, 7) if len(w) > n)
        names = found | {s + "*" for s in stems} | {s + "**" for s in stems if stems[s] > 1} | {s + "%" for s in stems if stems[s] > 1 and stems[s] * 100 >= len(found)}
        z = model.bias + sum(model.weights.get(zlib.crc32(n.encode()), 0.0) for n in names)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9

    def risk(z, positive, prior):
        loss = lambda m: np.log1p(np.exp(-m))
        rest = loss(-z[~positive]).mean() - prior * loss(-z[positive]).mean()
        return (prior * loss(z[positive]).mean() + rest) if rest >= 0 else -rest

    rng = np.random.default_rng(4)
    for scale in (0.5, 6.0):
        positive = np.arange(12) < 5
        z = np.where(positive, scale, -scale) + rng.normal(0, 0.1, 12)
        slope = pu_toxicity.risk_slope(z, positive, 0.4)
        for k in range(12):
            up, down = z.copy(), z.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((risk(up, positive, 0.4) - risk(down, positive, 0.4)) / 2e-5 - slope[k]) < 1e-6


def test_quality_scores_by_their_definition(corpus):
    """The forward pass, passage by passage, from the weights."""
    texts, labels = corpus
    model = mil_quality.train(texts, labels)
    p = model.weights
    for r in mil_quality.score(texts, model).join(texts, "doc_id").limit(40).collect():
        x = (mil_quality.passages(r.text.encode()).astype(float) - p["mean"]) / p["scale"]
        hs = [np.tanh(row @ p["W"] + p["b"]) for row in x]
        e = [math.exp(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"][:, 0])) for h in hs]
        z = sum(a / sum(e) * h for a, h in zip(e, hs))
        assert len(x) == -(-len(r.text.split()) // 64) and abs(r.score - 1 / (1 + math.exp(-float(z @ p["c"][:, 0] + p["d"][0])))) < 1e-6


def test_risk_never_goes_negative():
    positive = np.array([True, True, False, False])
    z = np.array([3.0, 3.0, -6.0, -6.0])
    plain, turned = pu_toxicity.risk_slope(z * 0, positive, 0.3), pu_toxicity.risk_slope(z, positive, 0.3)
    assert plain[2] > 0 > turned[2]


def test_quality_held_out(corpus, docs, no_docs):
    texts, labels = corpus
    model = mil_quality.train(texts, labels)
    got = mil_quality.score(texts, model).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 != 1) for r in got]) > 0.95
    assert ids_of(mil_quality.score(docs, model)) == ids_of(docs) and mil_quality.score(no_docs, model).count() == 0
    none = mil_quality.train(texts, labels.where("false"))
    assert {round(r.score, 6) for r in mil_quality.score(docs, none).collect()} == {0.5}


def test_attention_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(2)
    model = mil_quality.MilModel.start(3)
    x, starts, label = rng.normal(size=(9, mil_quality.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = model.forward(x, starts)["y"]
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))

    gradient = model.gradient(model.forward(x, starts), starts, label)
    for name, at in (("W", (3, 2)), ("V", (1, 4)), ("U", (0, 5)), ("w", (2, 0)), ("c", (1, 0)), ("b", (3,)), ("d", (0,))):
        kept = model.weights[name][at]
        around = []
        for step in (1e-5, -1e-5):
            model.weights[name][at] = kept + step
            around.append(loss())
        model.weights[name][at] = kept
        assert abs((around[0] - around[1]) / 2e-5 - gradient[name][at]) < 1e-6
