"""Periodic runs, exact dedup and token alignment against plain Python versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagestrata.llm import exact_dedup, periodic_runs, queries, token_alignment

TEXTS = [
    (1, "the cat sat on the mat"),
    (2, None),
    (3, ""),
    (4, "a"),
    (5, "la la la la la la la end"),
    (7, "the  cat\tsat\non the mat"),
    (8, " the cat sat on the mat"),
    (9, "naïve café 日本語 😀 \x00 ﬁ <|endoftext|> <s> </s> <0x41> ▁x"),
    (10, "x y " * 40),
    (11, "   \u0085x\x1cy"),
    (12, "é" * 300 + "aaaa" * 50),
    (13, "La La LA"),
    (14, " "),
    (15, "\n"),
    (None, "the cat sat on the mat"),
    (None, None),
    (1, "the cat sat on the mat"),
    (1, "other text of the same id"),
]


def frame(spark, texts, extra=False):
    if extra:
        return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in texts], "doc_id long, text string, row string, hash string, kept string, pairs string")
    return spark.createDataFrame(texts, "doc_id long, text string")


def plain_runs(w, least=6, exponent=4):
    seen, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_every_period(least, exponent):
    rnd = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.randint(0, 60), rnd.choice([1, 2, 2, 3, 5])
            w = [rnd.randrange(k) for _ in range(n)]
            if n > 4 and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(2, 9)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        got = [[] for _ in docs]
        bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
        for d, *r in zip(*[x.tolist() for x in periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), bounds, least, exponent)], strict=True):
            got[d].append(tuple(r))
        assert got == [plain_runs(d, least, exponent) for d in docs]


def test_children_are_tested_in_parts(monkeypatch):
    w = np.array(([0] * 40 + [1]) * 5)
    whole = [x.tolist() for x in periodic_runs.runs(w, np.array([0, len(w)]), 2, 2)]
    monkeypatch.setattr(periodic_runs, "TESTED", 3)
    assert [x.tolist() for x in periodic_runs.runs(w, np.array([0, len(w)]), 2, 2)] == whole


def test_long_periodic_texts_take_seconds(spark):
    a, b = [0], [0, 1]
    while len(b) < 400_000:
        a, b = b, b + a
    for w, n in (([0] * 400_000, 1), ([0, 1, 2] * 130_000, 1), (b, 0), (list(range(200_000)) * 2, 0)):
        assert len(periodic_runs.runs(np.array(w), np.array([0, len(w)]))[0]) == n


def run_row(doc_id, text):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    stays = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(stays)))


def test_run_query_equals_python(spark, tmp_path):
    rnd = random.Random(5)
    more = [(i, " ".join(rnd.choice("ab cd ef gh".split()) for _ in range(rnd.randint(0, 90)))) for i in range(100, 240)]
    frame(spark, [*TEXTS, *more], True).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_periodic_runs(spark, str(tmp_path))
    assert Counter(tuple(r) for r in df.collect()) == Counter(run_row(i, t) for i, t in [*TEXTS, *more])
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in more) > 5
    assert periodic_runs.find_runs(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_collapsed_text_keeps_first_periods(spark):
    row = periodic_runs.find_runs(frame(spark, [(1, "so la la la la la la it goes")])).first()
    assert [tuple(x) for x in row.runs] == [(1, 6, 1)]
    assert (row.n_words, row.collapsed) == (9, "so la it goes")


def plain_classes(texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    out = Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out.update((i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids))
    return out


def of_two_bits(text):
    return F.unhex(F.substring(F.md5(text), 1, 1))


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, of_two_bits, lambda t: F.lit(bytearray(b"x"))])
def test_exact_classes_equal_python_also_when_hashes_collide(spark, hash_of):
    assert Counter(tuple(r) for r in exact_dedup.exact_classes(frame(spark, TEXTS, True), hash_of).collect()) == plain_classes(TEXTS)


def test_copies_are_dropped_and_columns_pass(spark, monkeypatch):
    docs = frame(spark, TEXTS, True)
    for limit in (exact_dedup.BROADCAST_IDS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", limit)
        out = exact_dedup.drop_copies(docs)
        assert out.columns == docs.columns
        kept = Counter(i for (i, _, _, stays, _), n in plain_classes(TEXTS).items() for _ in range(n) if stays)
        assert Counter(r.doc_id for r in out.collect()) == kept
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOK.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_table():
    """The byte-level alphabet: printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokens(text):
    """((id, start, end) of A, of B) in bytes."""
    if not text:
        return [], []
    table, sides = byte_table(), []
    a_ids, b_ids = TOK.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    a_bytes = [bytes(table[c] for c in TOK.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
        if b"".join(parts) != f" {text}".encode():
            return [], []
        ends = np.cumsum([len(p) for p in parts]).tolist()
        sides.append(list(zip(ids, [0, *ends], ends, strict=False)))
    return tuple(sides)


def plain_links(text):
    a, b = tokens(text)
    return [(x, y, min(a[x][2], b[y][2]) - max(a[x][1], b[y][1])) for x in range(len(a)) for y in range(len(b)) if a[x][1] < b[y][2] and b[y][1] < a[x][2]]


def plain_groups(text):
    a, b = tokens(text)
    out, low = [], 0
    for high in sorted({x[2] for x in a} & {y[2] for y in b}):
        out.append(([i for i, s, e in a if low <= s and e <= high], [i for i, s, e in b if low <= s and e <= high]))
        low = high
    return out


def plain_alignment(texts):
    links = [[(tokens(t)[0][x][0], tokens(t)[1][y][0]) for x, y, _ in plain_links(t)] for _, t in texts]
    held = Counter(p for doc in links for p in set(doc))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (i, t), doc in zip(texts, links, strict=True):
        groups = plain_groups(t)
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out[(i, *map(len, tokens(t)), len(groups), len(doc), sum(held[p] == most[p[0]] for p in doc), sum(held[p] for p in doc), digest)] += 1
    return out


@pytest.mark.parametrize("stretch,broadcast", [(token_alignment.STRETCH, token_alignment.BROADCAST_PAIRS), (5, 0)])
def test_alignment_query_equals_python(spark, tmp_path, monkeypatch, stretch, broadcast):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", broadcast)
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", "é", "日本", "😀", "'s", "1234", "<|endoftext|>", "<unk>", "<0x0A>", "▁", "\x00", "ß", "ﬁ", "--", "word", " Word", "𐐀", " ", "​"]
    texts = [*TEXTS, *[(100 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))) for i in range(60)]]
    frame(spark, texts, True).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in queries.op13_token_alignment(spark, str(tmp_path)).collect()) == plain_alignment(texts)
    monkeypatch.setattr(token_alignment, "STRETCH", stretch)
    whole = [t or "" for _, t in texts]
    t = token_alignment.aligned(whole, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    made = [tuple(x) for links in token_alignment.overlaps(t) for x in zip(links.row.tolist(), links.column.tolist(), links.value.tolist(), strict=True)]
    plain, a, b = [], 0, 0
    for text in whole:
        plain += [(x + a, y + b, n) for x, y, n in plain_links(text)]
        a, b = a + len(tokens(text)[0]), b + len(tokens(text)[1])
    assert made == plain


def test_links_by_bytes_and_by_groups(spark):
    text = "naïve café 日本語 😀 aaaaaaaa wordings"
    docs = frame(spark, [(7, text), (8, None)])
    by_bytes = token_alignment.linked_tokens(docs)
    assert sorted((r.a_at, r.b_at, r.shared) for r in by_bytes.collect()) == plain_links(text)
    a, b, plain = 0, 0, set()
    for x, y in plain_groups(text):
        plain |= {(a + i, b + j) for i in range(len(x)) for j in range(len(y))}
        a, b = a + len(x), b + len(y)
    rows = token_alignment.linked_tokens(docs, by="groups").collect()
    assert len(rows) == len(plain) and {(r.a_at, r.b_at) for r in rows} == plain


def test_product_equals_dense_matrices():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.random((6, 5)) < 0.4, rng.random((5, 7)) < 0.4
        made = np.zeros((6, 7), int)
        left, right = (token_alignment.Csr(np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1]) for m in (x, y))
        links = token_alignment.product(left, right)
        made[links.row, links.column] = links.value
        assert (made == x.astype(int) @ y.astype(int)).all()
        back = token_alignment.transposed(right, 7)
        assert (back.columns == np.nonzero(y.T)[1]).all()


def test_very_long_texts(spark):
    docs = frame(spark, [(1, "word " * 400_000), (2, " " * 300_000), (3, "word " * 400_000), (4, "a" * 300_000)])
    rows = {r.doc_id: r for r in token_alignment.alignment_scores(docs).collect()}
    assert rows[1].n_a == 400_001 and rows[1].n_links >= rows[1].n_a and rows[1].groups_sha256 == rows[3].groups_sha256
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_classes(docs).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(docs).collect()} == {1: [(0, 400_000, 1)], 2: [], 3: [(0, 400_000, 1)], 4: []}
