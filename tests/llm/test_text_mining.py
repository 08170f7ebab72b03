"""Personal data, aligned tokens and phrases, each against a plain form."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import alignment, phrases, pii

# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(m.span())
        out.append(spans)
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["a@b.c", "@", "a.b+c@d-e.f.g_h@i.j", "1.2.3.4", "256.1.1.1", "01.002.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111111", "+49 (30) 123-4567", "+1", "é", " ", "-", ".", "7", "x@y", "a" * 50, "9" * 30, "\n"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 300_000 + "+1" + " " * 300_000) == [[], [], [], []]


def brute_disclosures(texts, reach, least, floor):
    near, entities, terms = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        terms.update(set(re.findall(r"\w+", t.lower())))
        pairs = [(e, w) for e, found in pii.surroundings(t, brute_base(t), reach) for w, _ in found]
        entities.update({e for e, _ in pii.surroundings(t, brute_base(t), reach)})
        near.update(set(pairs))
    n, out = len(texts), {}
    for (e, w), k in near.items():
        if k >= least and entities[e] < n:
            share = math.log(k * n / (terms[w] * entities[e])) / math.log(n / entities[e])
            if share >= floor:
                out[e, w] = share
    return out


def pii_rows():
    r = random.Random(2)
    word = lambda: r.choice(["the", "of", "and", "Green", "stone", "été"]) + r.choice(["", "", "s"])
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{fill(20)} Zora Quill, tel +49 30 1234567 or zora@quill.example.org {fill(12)}" if k % 4 == 0 else fill(40)) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "zora@quill.example.org"), (None, rows[0][1]), (3, rows[4][1]), (3, rows[4][1]), (53, fill(30_000) + " Quill zora@quill.example.org")]
    return rows


def test_terms_that_reveal(spark):
    rows = pii_rows()
    docs = spark.createDataFrame([(i, t, "row", None) for i, t in rows], "doc_id long, text string, row string, _spans int").drop("_spans")
    want = brute_disclosures([t for _, t in rows], 8, 3, 0.6)
    got = {(r.entity, r.term): r.share for r in pii.disclosures(docs.select("text"), 8, 3, 0.6, 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert ("email:zora@quill.example.org", "zora") in got and not [t for _, t in got if t in ("the", "of", "and")]
    whole = sorted((str(r.row.doc_id), r.text or "", str(r._spans)) for r in pii.spans(docs).collect())
    sliced = sorted((str(r.row.doc_id), r.text or "", str(r._spans)) for r in pii.spans(docs, most=1).collect())
    assert len(whole) == len(rows) and whole == sliced
    for r in pii.spans(docs).collect():
        spans = [(s.kind, s.start, s.end) for s in r._spans]
        assert [s for s in spans if s[0] in pii.BASE] == [(k, a, b) for k, v in zip(pii.BASE, brute_base(r.text or "")) for a, b in v]
        assert [pii.KINDS.index(k) for k, _, _ in spans] == sorted(pii.KINDS.index(k) for k, _, _ in spans)
        assert (len(spans) > 0) == any(brute_base(r.text or ""))
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.where("text like '%zora%' or lower(text) like '%quill%' or text like '%1234567%'").count() == 0
    assert clean.where("text is null").count() == 1 and clean.where("row = 'row'").count() == len(rows)
    assert pii.spans(docs.limit(0)).count() == 0


# aligned tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_links(data):
    a_of = Tokenizer.from_file(BYTES)
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spelled = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for b in [b for b in range(256) if b not in spelled.values()]:
        spelled[chr(256 + len([k for k in spelled if ord(k) >= 256]))] = b
    a_bytes = lambda i: bytes(spelled[c] for c in a_of.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for i, text in data:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        if any(b"".join(map(f, x)) != (" " + (text or "")).encode() for f, x in ((a_bytes, a), (b_bytes, b))):
            a, b = [], []
        end, at = {}, 0
        for k, x in enumerate(a):
            at += len(a_bytes(x))
            end[at] = k
        at = first_a = first_b = 0
        groups, links = [], []
        for k, x in enumerate(b):
            at += len(b_bytes(x))
            if at in end:
                groups.append(",".join(map(str, a[first_a : end[at] + 1])) + "|" + ",".join(map(str, b[first_b : k + 1])))
                first_a, first_b = end[at] + 1, k + 1
                links.append((a[end[at]], x))
        counts.update(links)
        docs.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return Counter((i, len(a), len(b), len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), digest(g) if a else "") for i, a, b, g, ls in docs)


def test_links_equal_brute_force(spark, docs, data):
    rows = [(i, t) for i, t, _ in data]
    rows += [(90, "<|endoftext|> <s> </s> naïve 東京 😀 don't"), (91, "a ▁ b"), (92, " x　 y\x00z"), (93, "  two  spaces "), (94, "x" * 3000), (95, "Ꟁ ⷠ 🫠 ಠ"), (None, "<unk>")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n_a int, key string").repartition(3)
    expected = brute_links(rows)
    for task_bytes in (4 << 20, 20_000):
        assert Counter(map(tuple, alignment.linked(df, BYTES, PIECES, task_bytes).collect())) == expected
    assert alignment.linked(df.limit(0), BYTES, PIECES).count() == 0


def test_the_faster_tokenizer_agrees():
    reader, r = alignment.ByteLevel(BYTES), random.Random(4)
    assert reader.fast
    for _ in range(2000):
        text = "".join(r.choice([chr(r.randrange(0x250)), " ", "'", "s", "\n", "1", "…", "€", "ll"]) for _ in range(r.randrange(30)))
        if not alignment._YOUNG.search(text):
            assert reader.ids(text) == reader.slow.encode(" " + text, add_special_tokens=False).ids


def test_groups_as_text():
    r = random.Random(5)
    import numpy as np

    for _ in range(200):
        k = r.randrange(1, 6)
        sizes = [(r.randrange(1, 4), r.randrange(1, 4)) for _ in range(k)]
        a, b = ([r.randrange(60_000) for _ in range(sum(s[j] for s in sizes))] for j in (0, 1))
        last = [np.cumsum([s[j] for s in sizes]) - 1 for j in (0, 1)]
        cut = lambda ids, ends: [",".join(map(str, ids[x:y])) for x, y in zip([0, *(ends[:-1] + 1)], ends + 1)]
        want = ";".join(f"{x}|{y}" for x, y in zip(cut(a, last[0]), cut(b, last[1])))
        assert alignment.grouped(np.array(a), np.array(b), *last).decode() == want


def test_words_joined_are_the_texts_tokens():
    both, r = alignment._both(BYTES, PIECES), random.Random(6)
    assert both.apart
    parts = ["a", "b", "The", " ", "  ", "\n", "\n ", "\t", "é", "’", "'s", "12", "3.4", "▁", "<|endoftext|>", "<s>", "\u00a0", "\x1c", "x" * 70, "京", " naïve"]
    texts = ["".join(r.choice(parts[: r.choice((8, 13, 21))]) if r.random() < 0.6 else f" w{r.randrange(50)}" for _ in range(r.randrange(12))) for _ in range(2000)] + [None, ""]
    for size in (1, 7, 500):
        for first in range(0, len(texts), size):
            some = texts[first : first + size]
            for text, found in zip(some, both.texts(pa.array(some, pa.string()))):
                want = (both.of(text) if text else None) or [[], []]
                assert [list(x) for x in found] == want


def test_a_word_is_read_once(monkeypatch):
    both, read = alignment._both(BYTES, PIECES), []
    plain = alignment.Both.of
    monkeypatch.setattr(alignment.Both, "of", lambda self, text: read.append(text) or plain(self, text))
    both.texts(pa.array([" ".join(f"word{k % 7}" for k in range(n)) for n in (500, 300, 1)]))
    assert sorted(" ".join(read).split()) == [f"word{k}" for k in range(7)]


# phrases


def brute_phrases(data, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in data:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        within = lambda p: any(len(q) > len(p) and n >= found[p] and any(q[k : k + len(p)] == p for k in range(len(q))) for q, n in found.items())  # noqa: B023, E731
        rows = []
        for p, a in found.items():
            if not within(p):
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, total[lang], score))
        rows.sort(key=lambda x: (-x[-1], -x[1], x[0].encode()))
        out += [(lang, k, *x) for k, x in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sentences():
    r = random.Random(6)
    words = ["The", "of", "red", "Stone", "été", "a\x01", "a", "größe", "x" * 300, "İ"]
    rows = [(k, " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n", "\t", ";;"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for k in range(60)]
    return rows + [rows[0], (None, rows[1][1], "en"), (70, None, "en"), (71, "", None), (72, "lone", "xx"), (73, "go go go " * 400, "en")]


def test_phrases_equal_brute_force(spark, sentences, monkeypatch):
    df = spark.createDataFrame([(*x, 5, "k") for x in sentences], "doc_id long, text string, lang string, n int, key string").repartition(3)
    want = brute_phrases([(t, lang) for _, t, lang in sentences], 4, 5, 40)
    assert sorted(map(tuple, phrases.collocations(df, least=4, top=40).collect())) == want
    # a dictionary too large to broadcast
    assert sorted(map(tuple, phrases.collocations(df, least=4, top=40, most=2).collect())) == want
    assert phrases.collocations(df.limit(0), least=4).count() == 0


def test_runs_over_several_chunks(monkeypatch):
    import numpy as np

    r = np.random.default_rng(7)
    rows = phrases.windows(r.integers(0, 5, 4000).astype(np.uint32), 5)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    for width in (1, 2, 4):
        sent = list(phrases._keys_of([r_ for r_ in np.array_split(np.r_[r.integers(0, 5, 3000)].astype(np.uint32), 7)], 5, width))
        keys = sum((Counter({tuple(k): n}) for b in sent for k, n in zip(phrases._unpacked(b["key"], 5, width).tolist(), b["n"].to_pylist())), Counter())
        got = Counter()
        for b in phrases._prefix_runs(10, 5, width)(iter(sent)):
            for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist()):
                got[k] += n
        want = Counter()
        for k, n in keys.items():
            for size in range(2, 6):
                if k[size - 1]:
                    want[b"".join(x.to_bytes(width, "big") for x in k[:size])] += n
        assert {k: n for k, n in got.items() if n >= 10} == {k: n for k, n in want.items() if n >= 10}
    order = phrases.radix_order(rows)
    assert rows[order].tolist() == sorted(rows.tolist())
