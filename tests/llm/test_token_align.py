import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbiter.llm import token_align

from .messy import SCHEMA, frame, prose, rows

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "tab\t x", "line\n\n  next\n", "ﬁ ① Ａ é é", "x▁y", "▁", "<|endoftext|> and <s> </s> <unk>", "\x00\x01 \x1c x",
    "日本語のテキスト と 한국어", "🙂🙃 👩‍👩‍👧", "a" * 5000, "ab" * 3000 + " " * 1500 + "c", "1234567890" * 30, "    z", "q\x85 r",
]


@pytest.fixture(scope="module")
def encoder():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        return token_align.Encoder(token_align.ByteLevel(a.read()), token_align.Pieces(b.read()))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(libraries, text):
    """[(ids of A, ids of B)] of the groups, by walking over both token lists of the libraries."""
    if not text:
        return []
    lib_a, lib_b = libraries
    shown = {}  # the printable stand-ins of bytes
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for i, b in enumerate(plain + [b for b in range(256) if b not in plain]):
        shown[chr(b) if i < len(plain) else chr(256 + i - len(plain))] = b
    a = [(i, bytes(shown[c] for c in lib_a.id_to_token(i))) for i in lib_a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in lib_b.encode(text):
        piece = lib_b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if lib_b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    groups, x, y, i, j = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x == y and x:
            groups.append(([], []))
        if x <= y:
            groups[-1][0].append(a[i][0])
            x, i = x + len(a[i][1]), i + 1
        if y < x:
            groups[-1][1].append(b[j][0])
            y, j = y + len(b[j][1]), j + 1
    return groups


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def check(encoder, libraries, texts):
    found = token_align.Aligned(encoder, texts)
    expected = [brute(libraries, t) for t in texts]
    assert [x.decode() for x in found.written_groups()] == [shown(g) for g in expected]
    assert found.n_links.tolist() == [sum(len(x) * len(y) for x, y in g) for g in expected]
    text, pair, many = found.pairs(40_000)
    links = Counter((i, a * 40_000 + b) for i, g in enumerate(expected) for x, y in g for a in x for b in y)
    assert Counter(dict(zip(zip(text.tolist(), pair.tolist(), strict=True), many.tolist(), strict=True))) == links


def test_groups_against_a_walk(encoder, libraries):
    check(encoder, libraries, ODD + [prose(k, 300) for k in range(8)] + [r[1] for r in rows()])
    check(encoder, libraries, [])
    check(encoder, libraries, [None, ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aé \n\t▁'s1.日🙂", max_size=80), max_size=6))
def test_groups_of_any_text(encoder, libraries, texts):
    check(encoder, libraries, texts)


def test_ends_that_part_for_long():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9, 1.0):
        n = 6000
        common = rng.random(n) < share
        common[-1] = True
        side = rng.random(n) < 0.5
        ends_a, ends_b = (np.flatnonzero(common | own) + 1 for own in (side, ~side))
        cut_a, cut_b = token_align.cut_groups(ends_a, ends_b, np.array([len(ends_a) - 1]))
        both = np.intersect1d(ends_a, ends_b)
        assert ends_a[cut_a].tolist() == both.tolist() == ends_b[cut_b].tolist()


def test_ranks_equal_the_vocabulary_file(encoder, libraries):
    """Every vocabulary entry that is text, and characters of every block, encode as the file's own library says."""
    side, lib = encoder.sides[0], libraries[0]
    assert side.ranked is not None
    flat, starts, lengths = side.bytes
    words = []
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        try:
            words.append(" " + flat[s : s + n].tobytes().decode())
        except UnicodeDecodeError:
            continue
    words += [f" a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(1, 0x20000, 7) if not 0xD800 <= c <= 0xDFFF]
    ids, counts = side.encode(words)
    expected = [e.ids for e in lib.encode_batch(words, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("group_bytes", [16 << 20, 3000])
def test_counts_against_brute_force(spark, libraries, group_bytes, monkeypatch):
    monkeypatch.setattr(token_align, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(token_align, "PART_BYTES", max(group_bytes // 8, 500))
    texts = ODD + [prose(k % 5, 60) for k in range(9)]
    got = token_align.count_links(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), A_PATH, B_PATH).collect()
    groups = [brute(libraries, t) for t in texts]
    count = Counter(p for g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    assert sorted(r.row.id for r in got) == list(range(len(texts)))
    for r in got:
        g = groups[r.row.id]
        links = [(a, b) for x, y in g for a in x for b in y]
        text = shown(g)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links))
        assert (r.n_best, r.count_sum) == (sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_real_groups_and_odd_tables(spark, libraries):
    docs = frame(spark)
    got = token_align.align_tokens(docs, A_PATH, B_PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        g, x, y = [], 0, 0
        for ea, eb in zip(r.ends_a, r.ends_b, strict=True):
            g.append((r.a[x:ea], r.b[y:eb]))
            x, y = ea, eb
        assert g == brute(libraries, r.row.text)
    assert token_align.count_links(docs, A_PATH, B_PATH).select("row.*").columns == docs.columns
    for found in (token_align.count_links, token_align.align_tokens):
        assert found(spark.createDataFrame([], SCHEMA), A_PATH, B_PATH).count() == 0


def test_query_reads_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    found = token_align.op11_token_align(spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found.where(F.col("n_best") > F.col("n_links")).count() == 0
