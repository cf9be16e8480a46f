import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.llm import decontaminate, jaccard_join, shingles, suffix_dedup

from .messy import WORD, frame, prose, rows, similar


def groups_of(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def near_copies(n, edits):
    base = prose(50, 150).split()
    out = []
    for k in range(n):
        words = list(base)
        rng = random.Random(k)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_links_against_all_pairs(spark, block):
    texts = [r[1] or "" for r in rows()] + near_copies(40, 7) + ["a b c", "a  b c", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs, block=block).collect()
    different = sorted(set(texts))
    pairs = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if similar(a, b)]
    copies = Counter(texts)
    links, linked = Counter(), Counter()
    for a, b in pairs:
        links[a] += copies[b]
        links[b] += copies[a]
        linked[a] += 1
        linked[b] += 1
    least = {t: texts.index(t) for t in different}
    group = groups_of(least.values(), [(least[a], least[b]) for a, b in pairs])
    assert len(got) == len(different)
    for r in got:
        t = texts[r.class_id]
        own = copies[t] - 1 if WORD.search(t) else 0
        assert (r.n_docs, r.n_links, r.n_linked_texts, r.group_id) == (copies[t], links[t] + own, linked[t], group[least[t]]), t[:40]


def test_one_document_of_each_group_stays(spark):
    docs = frame(spark)
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, None, 8, 9, 10, 11, 12, 13], key=str)
    assert jaccard_join.one_of_each_group(frame(spark, [])).count() == 0


def test_pruning_keeps_what_the_posterior_allows():
    need = jaccard_join.least_equal(0.8, 1e-6)
    assert list(need) == [32, 64, 96, 128] and all(0 < m < 0.8 * n for n, m in need.items())
    hashes, lengths = shingles.shingle_sets(near_copies(30, 5))
    sig = jaccard_join.signatures(hashes, lengths)
    ends = np.cumsum(lengths)
    sets = [hashes[e - n : e] for e, n in zip(ends, lengths, strict=True)]
    i, j = jaccard_join.surviving(sig, sig, True, 0.8, 1e-6)
    both = jaccard_join.overlaps(sets, i, j)
    assert both.tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    survivors = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(30):
        for b in range(a + 1, 30):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert len(x & y) < 0.8 * len(x | y) or (a, b) in survivors


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in shingles.connected(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_suffix_arrays_against_brute_force():
    random.seed(3)
    for _ in range(150):
        length, letters = random.choice([3, 5, 8]), random.choice([b"ab", b"abc", b"\x00a\xc3", b"a"])
        bodies = [bytes(random.choice(letters) for _ in range(random.randint(length, 40))) for _ in range(random.randint(1, 12))]
        often = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        got = suffix_dedup.repeated_windows(bodies, np.ones(len(bodies), int), length)
        assert [g.tolist() for g in got] == [[i for i in range(len(b) - length + 1) if often[b[i : i + length]] > 1] for b in bodies]


def brute_dedup(texts, length=400):
    bodies = [(t or "").encode() for t in texts]
    often = Counter(hash(b[i : i + length]) for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if often[hash(b[i : i + length])] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [None, 2000])
def test_removed_bytes_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 50_000)
    passage, short = prose(70, 110), prose(71, 60)[:300]
    texts = [r[1] for r in rows()] + [f"{prose(80 + i, 40)} {passage} {prose(90 + i, 40)} {short}é {prose(95 + i, 90)}" for i in range(5)]
    texts += ["ab" * 700, passage * 3, prose(99, 300) + "\n" + prose(99, 300), rows()[9][1][5000:25_000]]
    # One window of 400 bytes, each time among other words: segments of a single window.
    texts += [f"{prose(120 + i, 30)}{passage[:400]}{prose(160 + i, 30)}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "row", "key") for i, t in enumerate(texts)], "doc_id long, text string, row string, key string")
    got = suffix_dedup.dedup_texts(docs).collect()
    want = brute_dedup(texts)
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == dict(enumerate(want))


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.dedup_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_sort_as_their_bytes():
    rng = np.random.default_rng(1)
    for letters, length in ((2, 400), (4, 13), (200, 8), (1, 20)):
        text = rng.integers(0, letters, 3000).astype(np.uint8)
        at = np.sort(rng.choice(3000, 900, replace=False))
        raw = text.tobytes() + bytes(length)
        got = suffix_dedup.sorted_suffixes(text, at, length)
        assert [raw[p : p + length] for p in got] == sorted(raw[p : p + length] for p in at)
        assert sorted(got.tolist()) == at.tolist()


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    body = bytes(random.Random(1).choice(b"abcd") for _ in range(5000))
    seen = defaultdict(int)
    for part in suffix_dedup.pieces([b"", body, body[:399], body[:400]]):
        assert sum(len(b) for _, _, b in part) <= 1000
        for i, a, b in part:
            assert [b"", body, body[:399], body[:400]][i][a : a + len(b)] == b
            for k in range(len(b) - 399):
                seen[i, a + k] += 1
    assert dict(seen) == {(1, k): 1 for k in range(4601)} | {(3, 0): 1}


def test_leaks_are_found(spark):
    items = [(i, prose(200 + i, 20 + 5 * i)) for i in range(8)]
    benchmark = spark.createDataFrame([*items, (98, None), (99, "too short"), (100, prose(300, 200))], "item_id long, text string")
    texts, want = [], []
    for i, t in items:
        words = t.split()
        fewer = [w for k, w in enumerate(words) if k % 8 != 5]
        for form in (t, t.upper().replace(".", ""), " ".join(fewer), "\n".join(words)):
            texts.append(f"{prose(400 + len(texts), 75)} {form} {prose(500 + len(texts), 130)}")
            want.append({i})
    texts.append(prose(600, 50) + " " + " ".join(prose(300, 200).split()[60:140]) + " " + prose(601, 50))
    want.append({100})
    clean = [r[1] for r in rows()] + [prose(700 + k, 300) for k in range(20)] + [" ".join(random.Random(k).sample(items[7][1].split(), 50)) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "key") for i, t in enumerate(texts + clean)], "doc_id long, text string, key string")
    found = decontaminate.leaks(docs, benchmark)
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    got = defaultdict(set)
    for r in docs.select("doc_id", key.alias("k")).join(found, F.col("k") == found.key).collect():
        got[r.doc_id].add(r.item_id)
    hits = sum(want[i] <= got[i] for i in range(len(texts)))
    assert hits >= 0.9 * len(texts) and all(got[i] <= want[i] for i in range(len(texts)))
    assert not any(got[len(texts) + i] for i in range(len(clean)))
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(texts + clean) - sum(bool(got[i]) for i in range(len(texts)))
    assert decontaminate.leaks(docs.where("false"), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.where("false")).count() == 0


def test_every_leak_the_verdict_accepts_is_found(spark):
    """Paraphrases of items of 8 to 88 words among words of the same benchmark, against the verdict over all windows."""
    rng = random.Random(1)
    often = [1 / (k + 3) for k in range(2000)]
    line = lambda n: rng.choices([f"w{k}" for k in range(2000)], often, k=n)
    parts = [line(8 + i % 81) for i in range(400)]
    texts = []
    for k in range(240):
        part = parts[k]
        kept = rng.sample(range(len(part)), -(-len(part) * (3 if k % 2 else 4) // (4 if k % 2 else 6)))
        texts.append(" ".join(line(20 + k % 90) + [w if j in kept else line(1)[0] for j, w in enumerate(part)] + line(20 + k % 70)))
    items = decontaminate.Items(list(range(400)), [" ".join(p) for p in parts])
    terms, n = decontaminate.coded(texts)
    want = set()
    for i, (end, m) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
        for q, size in enumerate(items.size.tolist()):
            for b in range(0, max(-(-m // decontaminate.STRIDE) * decontaminate.STRIDE - size, 0) + 1, decontaminate.STRIDE):
                if decontaminate.verdict(items, q, terms[max(end - m + b - decontaminate.MARGIN, end - m) : min(end - m + b + size + decontaminate.MARGIN, end)]):
                    want.add((texts[i], items.item[q]))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(parts)], "item_id long, text string"))
    digests = {hashlib.md5(t.encode()).digest(): t for t in texts}
    assert len(want) > 100 and {(digests[bytes(r.key)], r.item_id) for r in found.collect()} == want


def test_latent_directions_are_fitted_on_all_documents(spark):
    """More documents than a sample would hold: every window of each takes part, and the directions are those of all."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words + ["other"], k=rng.choice([0, 3, 64, 65, 150]))) for _ in range(2500)] + [None]
    items = decontaminate.Items([0, 1], [" ".join(words[:40]), " ".join(words[30:])])
    items.weigh(items.vocabulary, np.linspace(1, 2, len(items.vocabulary)))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    held = decontaminate.fit_windows(docs, items).collect()
    windows = []
    for text in texts:
        terms = decontaminate.coded([text])[0]
        windows += [terms[a : a + decontaminate.SIZES[-1]] for a in range(0, len(terms), decontaminate.SIZES[-1])]
    assert sum(r.n for r in held) == len(windows)
    row, place, weight, norm = items.rows(windows)
    assert sum(np.frombuffer(r.times, np.uint16).sum() for r in held) == round((weight / items.weight[place]).sum())
    dense = np.zeros((len(windows), len(items.vocabulary)))
    dense[row, place] = weight / norm[row]
    block = np.random.default_rng(0).standard_normal((dense.shape[1], 5))
    back, gram = np.zeros(block.shape), np.zeros((5, 5))
    for r in held:
        at, to, times = (np.frombuffer(x, kind) for x, kind in ((r.row, np.uint16), (r.place, np.int32), (r.times, np.uint16)))
        value = times * items.weight[to]
        value = value / np.sqrt(np.bincount(at, value * value, r.n))[at]
        gram += decontaminate.multiplied(at, to, value, r.n, block, back)
    assert np.allclose(back, dense.T @ dense @ block) and np.allclose(gram, block.T @ dense.T @ dense @ block)


def test_products_of_the_fit_hold_few_columns_at_once():
    """A part of a product is a dense matrix of its own terms: no row of the block is copied for each entry, and none without an entry is touched."""
    rng = np.random.default_rng(3)
    seen = []

    class Block(np.ndarray):
        def __getitem__(self, key):
            seen.append(np.size(key))
            return np.asarray(self)[key]

    block = rng.standard_normal((5000, 6)).astype(np.float32)
    entry = np.unique(rng.integers(0, 64 * 5000, 900))
    row, place = entry // 5000, entry % 5000 // 20 * 20
    pair, value = np.unique(row * 5000 + place, return_counts=True)
    row, place = pair // 5000, pair % 5000
    dense = np.zeros((64, 5000))
    dense[row, place] = value
    back = np.zeros((5000, 6))
    gram = decontaminate.multiplied(row, place, value.astype(float), 64, block.view(Block), back)
    assert sum(seen) == len(np.unique(place)) < len(place)
    assert np.allclose(back, dense.T @ dense @ block, rtol=1e-4, atol=1e-3) and np.allclose(gram, block.T @ dense.T @ dense @ block, rtol=1e-4, atol=1e-2)
    assert decontaminate.FIT_WINDOWS <= 64
    assert not decontaminate.multiplied(row[:0], place[:0], value[:0], 3, block, back).any()


def test_texts_are_cut_into_words_once(spark, tmp_path):
    """Frequencies, fit and search read the words that one pass wrote, not the texts."""
    item = prose(210, 30)
    docs = spark.createDataFrame([(i, f"{prose(820 + i, 70)} {item if i % 2 else ''}") for i in range(6)] + [(6, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.read.parquet(f"{tmp_path}/docs"), benchmark)
    assert found.count() == 3
    assert not [f for f in found.inputFiles() if f"{tmp_path}/docs" in f]


def test_words_by_their_definition_and_their_places(spark):
    texts = [r[1] for r in rows()] + ["don't  “Stop”…it's 3.5% (a.b) . - x", "ÉCOLE straße—Ünï « q »", "y" * 700 + ".z", "y" * 700 + ".Z!", "", "...", "a\x0bb\x0cc"]
    plain = []
    for text in texts:
        low = (text or "").lower()
        for c in "…“”‘’„«»¡¿—–":
            low = low.replace(c, " ")
        plain.append([w for w in (x.strip(".,;:!?\"'()[]{}<>|*#&%$-_`~") for x in re.split("[ \t\n\r\x0b\x0c]+", low)) if w])
    terms, n = decontaminate.coded(texts)
    flat = [w for one in plain for w in one]
    assert n.tolist() == [len(one) for one in plain]
    assert len(set(zip(flat, terms.tolist(), strict=True))) == len(set(flat)) == len(set(terms.tolist()))
    vocabulary = np.unique(terms)[::2]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    kind, end = decontaminate.place_kind(vocabulary), np.cumsum(n)
    got = {r.key: np.frombuffer(r.place, kind) for r in decontaminate.word_places(docs, vocabulary).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        own = terms[end[i] - n[i] : end[i]]
        assert np.append(vocabulary, np.uint64(0))[got[i]].tolist() == np.where(np.isin(own, vocabulary), own, np.uint64(0)).tolist()


def test_candidates_hold_what_plain_counts_of_rarest_words_say():
    """Pairs of neighbouring tiles that hold a passage's rarest words, whatever number of tiles is counted at once."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    items = decontaminate.Items(list(range(12)), [" ".join(rng.choices(words, k=10 + i)) for i in range(12)])
    items.weigh(items.vocabulary, np.random.default_rng(1).uniform(1, 2, len(items.vocabulary)))
    terms, n = decontaminate.coded([" ".join(rng.choices(words, k=k)) for k in (0, 5, 112, 113, 400, 900)])
    place = decontaminate.places(items.sought, terms)
    want = set()
    for t, (end, size) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
        own = place[end - size : end]
        for k in range(-(-size // decontaminate.TILE)):
            there = set(own[k * decontaminate.TILE : (k + 2) * decontaminate.TILE].tolist())
            for q in range(12):
                begin = int(items.n_chosen[:q].sum())
                mine = range(begin, begin + int(items.n_chosen[q]))
                if sum(int(items.times[c]) for c in mine if items.chosen[c] in there) >= items.least[q]:
                    want.add((t, k, q))
    for scores in (1 << 22, 30):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decontaminate, "SCORES", scores)
            assert set(zip(*(x.tolist() for x in decontaminate.holding(items, place, n)), strict=True)) == want
    assert want


def test_the_last_product_of_the_fit_leaves_out_what_is_not_read():
    rng = np.random.default_rng(5)
    entry = np.unique(rng.integers(0, 8 * 40, 60))
    block, value = rng.standard_normal((40, 3)), rng.random(len(entry))
    back = np.zeros((40, 3))
    whole = decontaminate.multiplied(entry // 40, entry % 40, value, 8, block, back)
    assert back.any() and np.array_equal(decontaminate.multiplied(entry // 40, entry % 40, value, 8, block, None), whole)


def test_sums_of_the_fit_are_made_by_the_workers_of_the_other_steps(spark, monkeypatch):
    """An RDD's Python workers are others than a table's, and stay in an executor's memory beside them."""
    frame_type = type(spark.range(0))
    monkeypatch.setattr(frame_type, "rdd", property(lambda self: pytest.fail("workers of an RDD")))
    monkeypatch.setattr(decontaminate, "SUM_ROWS", 3)
    item = prose(70, 40)
    docs = frame(spark, [(i, prose(i, 90) + (" " + item if i % 3 == 0 else ""), "en", "a", 9, "r", None, 7, i) for i in range(12)]).repartition(5)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.key for r in decontaminate.leaks(docs, benchmark).collect()}
    assert len(found) == 4
    parts = [(p, np.full(2, x).tobytes()) for p, x in ((0, 1.0), (0, 2.0), (1, 5.0), (0, 4.0), (1, 0.5))]
    parts = spark.createDataFrame(parts, "piece int, value binary").repartition(3, "piece").sortWithinPartitions("piece")
    total = {r.piece: np.frombuffer(r.value).tolist() for r in parts.mapInArrow(decontaminate.added, "piece int, value binary").collect()}
    assert total == {0: [7.0, 7.0], 1: [5.5, 5.5]}


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)
