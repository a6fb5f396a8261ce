"""The training-data operators against brute force on small fixtures, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import bpe, chat, forest, jaccard, license, packing, quality, repetition, spans, suffix_dedup, suffixarray  # noqa: E402
from tessera.llm.common import Workspace, components  # noqa: E402

WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "Éta", "zug", "omega", "kappa", "rho", "tau", "über", "x1", "end."]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): random texts, exact and near copies, shared passages, empty, null, long and repeated rows."""
    rng = random.Random(3)
    docs = [text(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = ". ".join(text(rng, 14) for _ in range(6)) + "."
    docs += [f"{text(rng, 30)}. {passage} {text(rng, 20)}" for _ in range(12)]
    base = text(rng, 200)
    docs += [base] * 4
    for i in range(12):
        w = base.split()
        for j in range(i % 4):
            w[(i * 13 + j * 50) % 200] = f"new{i}"
        docs.append(" ".join(w))
    docs += ["", "   \n ", None, "one", "one", "one two three", "a" * 3000, "ab" * 900 + "\n" + "ab" * 900, "é" * 500, text(rng, 6000)]
    docs += ["Same line here with words\n" * 12 + text(rng, 20)]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + [(rows[5][0], rows[5][1]), (None, text(rng, 40))]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


def words_of(t, lower=False):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if lower else (t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


# 1


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, keep_ids=True).collect()
    expected = Counter()
    for doc_id, body in corpus:
        ids = t.encode(body or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            piece = ids[a : a + 2048]
            expected[(doc_id, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_rounds_and_bounds(spark):
    rng = random.Random(9)
    sizes = [rng.choice([rng.randint(1, 2048), 1025, 600, 1500, 3]) for _ in range(3000)]
    rows = spark.createDataFrame([(i, s, i * 7919) for i, s in enumerate(sizes)], "doc_id long, length long, lot long")
    ws = Workspace(spark, "test")
    packed = packing.pack(ws.save(rows), group=300).cache()
    assert packed.count() == 3000
    used, bound = packing.certificate(packed)
    assert bound <= used <= bound * 1.01 + 2
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(8, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        best = _fewest(sorted(map(int, lengths), reverse=True), capacity)
        assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1)) <= best
        assert len(packing.best_fit_decreasing(lengths, capacity)[2]) >= best


def _fewest(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json")).count() == 0


def test_sequences(docs):
    packed = packing.pack_documents(docs, P.path("word_bpe_49k.json"), keep_ids=True)
    total = packed.agg(F.sum("length")).first()[0]
    assert packing.sequences(packed).agg(F.sum(F.size("ids"))).first()[0] == total


# 2


def test_rotation(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 70, None, "late"), (2, 0, "a", "x"), (None, 0, "a", "n"), (None, None, "b", "m"), (1, 1, "b", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("participant", F.lit("clash"))
    found = {(r.conv_id, r.participant): r for r in chat.rotate(df).collect()}
    assert len(found) == 3 + 1 + 2 and {(r.part, r.start) for r in found.values()} == {(0, 0)}
    one = found[1, "a"]
    assert one.text == "<|assistant|>\nhi<|end|>\n<|user name=b|>\n<|end|>\n<|user name=b|>\n<|end|>\n<|user name=unknown|>\nlate<|end|>\n"
    assert [one.text[s.start : s.end] for s in one.mask] == ["hi<|end|>\n"]
    assert [found[1, "unknown"].text[s.start : s.end] for s in found[1, "unknown"].mask] == ["late<|end|>\n"]
    assert found[None, "b"].text.startswith("<|assistant|>\nm")
    assert chat.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("lot", [1024, 2])
def test_rotation_of_long_dialogues(spark, tmp_path, monkeypatch, lot):
    """Parts in order are the dialogue, masks are positions in it, and the query gives its SQL's rows.

    Crowded turns amid others, many turns, null turns and ids, equal messages and a very long text.
    """
    monkeypatch.setattr(chat, "LOT", lot)
    rows = [(1, t, f"r{i % 3}", f"m{i:04}") for t, n in ((None, 300), (0, 5), (1, 900), (2, 4), (3, 600), (70, 2)) for i in range(n)]
    rows += [(1, 1, "r0", "same")] * 700 + [(None, 0, "a", f"x{i}") for i in range(400)] + [(2, 0, "a", "x"), (2, 1, "b", "y" * 200_000)]
    rows += [(3, i, "ab"[i % 2], f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    views = defaultdict(list)
    for r in chat.rotate(df).collect():
        views[r.conv_id, r.participant].append(r)
    for (conv, me), found in views.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2], r[3]))
        found.sort(key=lambda r: r.part)
        whole = "".join(("<|assistant|>\n" if r[2] == me else f"<|user name={r[2]}|>\n") + r[3] + "<|end|>\n" for r in own)
        assert "".join(r.text for r in found) == whole
        assert all(whole[r.start :].startswith(r.text) for r in found)
        assert [whole[s.start : s.end] for r in found for s in r.mask] == [r[3] + "<|end|>\n" for r in own if r[2] == me]
        assert max(r.n_messages for r in found) <= 256
    duckdb = pytest.importorskip("duckdb")
    from tessera.llm import queries

    df.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    expected = Counter(db.execute(queries.SQL["op2_perspective_rotation"]).fetchall())
    assert Counter(tuple(r) for r in queries.op2_perspective_rotation(spark, str(tmp_path)).collect()) == expected


# 3


def test_repetition(docs, corpus):
    found = defaultdict(list)
    for r in repetition.judge(docs.withColumn("KEPT", F.lit("clash"))).collect():
        found[r.doc_id].append(r)
    for doc_id, body in corpus:
        w = words_of(body)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        longest = 0
        for v in at.values():
            for a in range(len(v)):
                for b in range(a):
                    if b > 40:
                        break
                    k = 0
                    while v[a] + k < len(w) and v[b] + k < len(w) and w[v[a] + k] == w[v[b] + k]:
                        k += 1
                    longest = max(longest, k)
        lines = [x for x in (body or "").split("\n") if words_of(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body or "")), len(lines) - len(set(lines)), len(covered), failed)
        for r in found[doc_id]:
            if r.n_words == expected[0] or len(found[doc_id]) == 1:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
                assert r.longest_repeat == longest
                chars = sum(len(w[j]) for j in covered)
                assert r.covered_chars == chars
                assert r.kept == (not failed and chars <= 0.25 * expected[1] and longest <= max(20, 0.15 * len(w)))


def test_repetition_beyond_the_base_rule(spark):
    """The covered share of characters and the longest repeat reject texts that the base rule lets pass."""
    rng = random.Random(6)
    line = " ".join(f"extraordinarily{rng.randint(0, 99)}" for _ in range(8))
    short = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(200))
    once = " ".join(f"u{i}" for i in range(30))
    rows = [(1, f"{line} {short} {line}"), (2, f"{once} {long} {once}"), (3, long)]
    found = {r.doc_id: r for r in repetition.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not found[1].base_failed and found[1].covered_chars > 0.25 * found[1].word_chars and not found[1].kept
    assert not found[2].base_failed and found[2].longest_repeat == 30 and found[2].kept
    assert found[3].kept and found[3].covered_chars == 0


def test_repetition_longest(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(40))
    body = " ".join(f"b{i}" for i in range(200))
    r = repetition.judge(spark.createDataFrame([(1, f"{passage} {body} {passage}")], "doc_id long, text string")).first()
    assert r.n_repeat_words == 80 and r.longest_repeat == 40
    assert r.base_failed == (100 * 80 > 30 * 280) and not r.base_failed
    assert not r.kept or r.longest_repeat <= 0.15 * r.n_words


# 4


def test_spans(spark):
    a, b, c = "Alpha beta gamma delta epsilon.", "Zeta eta theta iota kappa!", "Lambda mu nu xi omicron?"
    rows = [(1, f"{a} {b} {c} tail one"), (2, f"other start. {a}\n{b} more here now."), (3, None), (4, ""), (5, f"{a} {b} {a} {b} rest"), (6, "Es. An. It. Es. An. It."), (None, "nothing shared in here at all. Really nothing at all here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"i": F.lit(1), "h": F.lit(2), "key": F.lit(3), "spots": F.lit(4), "_key": F.lit(5)})
    found = {r.doc_id: r for r in spans.dedup_spans(df, min_words=8).collect()}
    assert all((r.key, r.spots, r._key) == (3, 4, 5) for r in found.values())
    # the null id has other sentences; document 1 has the first occurrence of both runs
    assert found[1].n_removed == 0 and found[1].text == rows[0][1]
    assert found[2].text == "other start. more here now." and found[2].n_removed == 2
    assert found[3].text is None and found[4].text == ""
    assert found[5].text == "rest" and found[5].n_removed == 4
    assert found[6].n_removed == 0
    assert spans.dedup_spans(df.limit(0)).count() == 0


def test_spans_by_default_have_sixteen_words(spark):
    """Ten words in two sentences may recur by chance; a longer run goes from all but its first text, repeated rows and a very long text included."""
    rng = random.Random(5)
    short = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa."
    long = "Alpha beta gamma delta epsilon zeta eta theta. Lambda mu nu xi omicron pi rho sigma."
    filler = lambda n: " ".join(f"{text(rng, 12)}." for _ in range(n))
    rows = [(1, f"{filler(1)} {short} {long} {filler(1)}"), (2, f"{filler(1)} {short} {filler(1)}"), (3, f"{filler(2)} {long} {filler(800)}"), (4, f"{long}"), (4, f"{long}")]
    found = [(r.doc_id, r.n_removed) for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == [(1, 0), (2, 0), (3, 2), (4, 2), (4, 2)]


# 5


def test_bpe(docs, corpus):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = Counter()
    for doc_id, body in corpus:
        ids = enc.encode_ordinary(body or "")
        expected[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((body or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == expected
    back = bpe.decode_ids(bpe.encode_texts(docs, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_bpe_odd_spaces():
    tiktoken = pytest.importorskip("tiktoken")
    import pyarrow as pa

    from tessera.llm.textbytes import from_arrow

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    letters = " \n\t\x0b\x1c\x1d\x85\xa0   　 éaA1'.s\U0001f600́"
    odd = ["", " ", "<|endoftext|> x", "don't I'LL 's", "\n\n a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for t, (ids, _, raw) in zip(odd, bpe._encoded(from_arrow(pa.array(odd)), bpe._units(path, P.PATTERN)), strict=True):
        assert enc.encode_ordinary(t) == ids.tolist() and raw == t.encode()


# 6


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(400):
        alphabet = rng.choice([1, 2, 3, 5, 200])
        s = bytes(rng.randint(1, alphabet) for _ in range(rng.randint(1, 60)))
        s = (s * 3 if rng.random() < 0.3 else s) + b"\0"
        t = np.frombuffer(s, np.uint8)
        sa = suffixarray.suffix_array(t)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        plcp, _ = suffixarray.permuted_common_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert plcp[b] == k


@pytest.mark.parametrize(("hot", "passage"), [(400, None), (2, 256), (400, 256)])
def test_suffix_dedup(docs, corpus, hot, passage):
    """Also with contexts of hot grams cut down to single windows, and with the smaller size first."""
    bodies = [(i, (t or "").encode()) for i, t in corpus]

    def covered(size):
        seen = Counter(b[k : k + size] for _, b in bodies for k in range(len(b) - size + 1))
        for _, b in bodies:
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - size + 1):
                if seen[b[k : k + size]] > 1:
                    gone[k : k + size] = True
            yield gone

    expected = Counter()
    for (i, b), gone, less in zip(bodies, covered(400), covered(passage or 400), strict=True):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        expected[(i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([int(less.sum())] if passage else []))] += 1
    clashing = docs.withColumns({"n_spans": F.lit("clash"), "id": F.lit(1), "spans": F.lit(2), "_id": F.lit(3), "th": F.lit(4)})
    out = suffix_dedup.dedup_suffixes(clashing, 400, hot, passage=passage).withColumn("sha", F.sha2("kept", 256))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "sha"] + ["n_passage_bytes"] * bool(passage)
    assert Counter(tuple(r) for r in out.select(*columns).collect()) == expected
    assert out.select("id", "spans", "_id", "th").distinct().collect() == [(1, 2, 3, 4)]


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7


def brute_components(rows, n=4, percent=85):
    """(id, size of the set, least id of the component) of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words_of(t, True)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_jaccard(docs, corpus):
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == brute_components(corpus)


def test_jaccard_near_misses(spark, monkeypatch):
    """Similar texts, most of which do not link: members of meetings grow with N * N / BLOCK, not with N * N, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    met, keep = [], Workspace.save

    def save(self, df, name="t"):
        out = keep(self, df, name)
        if name == "present":
            met.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", save)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    found = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert found == brute_components(rows)
    assert len(found) > 20 and sum(met) <= 4 * len(rows) ** 2 / 16


def test_jaccard_chain(spark):
    """Each text is near the next one only: groups must meet through the matrix."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(40)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert found.select("component_id").distinct().collect()[0][0] == 0
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 199), rng.randint(100, 199)) for _ in range(70)] + [(5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()))
    assert all(found[i] == 0 for i in range(61))
    for a, b in edges:
        if a != b:
            assert found[a] == found[b] <= min(a, b)


# 8


@pytest.mark.parametrize("node_rows", [8192, 150])
def test_forest(spark, node_rows):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1):
        centres = rng.normal(size=(120, 16))
        for c in centres:
            for _ in range(int(rng.integers(1, 5))):
                rows.append((k, [float(x) for x in c + rng.normal(0, 0.08, 16)], label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, None, 0), (k + 2, [0.0] * 16, 0), (k + 3, [float("nan")] * 16, 1), (k + 4, rows[3][1], None), (k + 5, [1.0, None] * 8, 1), (k + 6, [3.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1))
    found = {r.vec_id: r for r in forest.near_duplicates(df, node_rows=node_rows, leaf=40).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = Counter()
    for a in range(len(good)):
        for b in range(a):
            (i, v, x), (j, w, y) = good[a], good[b]
            if x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
    got = sum(r.n_links for r in found.values())
    assert all(r.n_links <= links[i] for i, r in found.items())
    assert got >= 0.9 * sum(links.values()) > 0
    assert found[k].n_links >= 1 and found[k + 1].n_links == 0 and found[k + 4].kept
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_dense_group(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    rows = [(i, [float(x) for x in centre + rng.normal(0, 0.02, 32)], 0) for i in range(900)] + [(900 + i, [float(x) for x in rng.normal(size=32)], 0) for i in range(600)]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.filter("vec_id < 900").agg(F.avg("n_links")).first()[0] >= 0.97 * 899


@pytest.mark.parametrize("node_rows", [8192, 1500])
def test_forest_loose_group(spark, node_rows):
    """3,000 vectors with cosines around 0.95 among 1,500 others, in one node and in a label above a node."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    spread = np.linalg.norm(centre) * np.sqrt((1 / 0.95 - 1) / 64)
    vectors = np.vstack([centre + rng.normal(0, spread, (3000, 64)), rng.normal(size=(1500, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert 0.5 < expected[:3000].mean() / 2999 < 1
    found = {r.vec_id: r for r in forest.near_duplicates(df, node_rows=node_rows).collect()}
    got = np.array([found[i].n_links for i in range(len(vectors))])
    assert (got <= expected).all() and got.sum() >= 0.99 * expected.sum()


def test_forest_group_above_a_node(spark):
    """9,000 vectors that link with each other, one of them twice, are more than a node holds."""
    rng = np.random.default_rng(6)
    vectors = np.vstack([rng.normal(size=16) + rng.normal(0, 0.02, (9000, 16)), rng.normal(size=(500, 16))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(9500, vectors[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    assert all(found[i].n_links >= 9000 and found[i].component_id == found[0].component_id for i in [*range(9000), 9500])
    assert sum(found[i].n_links for i in range(9000, 9500)) < 9000


# 9


def test_license(docs, spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0. MIT\nLicense; cc-by and the GNU general  public license"),
        (2, "licensed under teh apache licence, version 2.0"),
        (3, None),
        (4, "mit licenses are no mit licence"),
        (5, ""),
        (6, "plain words " * 50),
    ]
    found = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        hits = [(k, label) for phrase, label in license.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert found[2].base_labels == "" and "apache" in found[2].labels and 0.8 < found[2].score < 1
    span = found[2].spans[0]
    assert rows[1][1][span.start : span.end].startswith("licensed under") and 0 < span.errors <= 4
    assert found[6].labels == "" and found[6].score == 0


# 10


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = " ".join(rng.choice(WORDS) + ("###" if bad and rng.random() < 0.5 else "") for _ in range(rng.randint(20, 60)))
        rows.append((i, t))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    rows += [(1000, ""), (1001, None), (None, "x"), (5, rows[5][1])]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = quality.classify(docs_, spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, quality int")).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    right = sum(r.predicted == (r.doc_id % 4 != 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(r.score == 0.5 for r in quality.classify(docs_, spark.createDataFrame([], "doc_id long, quality int")).collect())
    assert quality.classify(docs_.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_quality_weights(spark):
    """The weights are those of one dense ridge regression over all rows; the knots come from rows scored by the other folds' weights."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, quality.FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 300) > 0.4).astype(float)
    train = spark.createDataFrame([([float(a) for a in v], float(b)) for v, b in zip(x, y, strict=True)], "stats array<double>, label double").repartition(3)
    model = quality.fit(train, features=24, ridge=1e-3)
    z = model.expand(x)

    def dense(rows):
        penalty = np.eye(25) * 1e-3 * 300
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])

    assert np.allclose(model.weights, dense(np.arange(300)), atol=1e-8)
    fold = np.array([r[1] for r in sorted(train.select("stats", F.pmod(F.xxhash64("stats"), F.lit(quality.FOLDS)).alias("f")).collect(), key=lambda r: list(r[0]))])
    order = sorted(range(300), key=lambda i: list(x[i]))
    by_row = dict(zip(order, fold, strict=True))
    scores = np.array([z[i] @ dense(np.array([j for j in range(300) if by_row[j] != by_row[i]])) for i in range(300)])
    bins = np.rint(np.clip(scores, -1, 2) * 500).astype(int)
    at, inverse = np.unique(bins, return_inverse=True)
    knots = quality.isotonic(at / 500, np.bincount(inverse, y), np.bincount(inverse).astype(float))
    assert np.allclose(model.knots[0], knots[0]) and np.allclose(model.knots[1], knots[1])


def test_isotonic():
    x, rate = quality.isotonic(np.arange(5.0), np.array([0.0, 3, 1, 4, 5]), np.array([5.0, 5, 5, 5, 5]))
    assert (np.diff(rate) >= 0).all() and rate[0] == 0 and rate[-1] == 1


# pipeline


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    wide = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    labels = [(i, int(len(words_of(t)) > 3)) for i, t in corpus if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    stage, before = wide, wide.count()
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        made = f(spark, stage, str(tmp_path))
        if k < 4:
            assert made.columns == wide.columns and [t for _, t in made.dtypes] == [t for _, t in wide.dtypes]
        made.write.parquet(f"{tmp_path}/out{k}")
        stage = spark.read.parquet(f"{tmp_path}/out{k}")
        assert k == 4 or stage.count() <= before
        before = stage.count()
    near = spark.read.parquet(f"{tmp_path}/out2")
    seen = jaccard.jaccard_components(near)
    assert seen.filter("doc_id <> component_id").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == stage.agg(F.sum("length")).first()[0]


def test_pipeline_near_copies(spark):
    """Copies with a five-word similarity from 0.80 to 0.85 go; one below 0.80 stays."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    a, b, c = ([f"{rng.choice(WORDS)}{rng.randint(0, 10**6)}" for _ in range(300)] for _ in range(3))
    more = [f"more{i}" for i in range(100)]
    rows = [(1, a), (2, a + more[:60]), (3, b), (4, b[55:]), (5, c), (6, c + more[:85])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {1, 3, 5, 6}


def test_pipeline_verdicts_are_of_rows(spark, tmp_path):
    """A doc_id on two texts and null doc_ids: each row has its own verdict."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    base, other = text(rng, 100), text(rng, 100)
    near = base + " tail"
    rows = [(1, base), (1, near), (2, near), (2, other), (None, base), (None, base), (3, other), (3, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept[None, base] == 2 and kept[2, other] == 1 and kept[2, near] == 0 and kept[3, other] == 0
    assert kept[1, base] + kept[1, near] == 1 and sum(kept.values()) == 4

    good, bad = [text(rng, 80) for _ in range(61)], ["#$ %% ** 11 " * rng.randint(5, 60) for _ in range(61)]
    rows = [*enumerate(good[:60] + bad[:60]), (500, good[60]), (500, bad[60]), (None, good[60]), (None, bad[60])]
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in corpus_pipeline.quality(spark, df, str(tmp_path)).collect())
    assert kept == Counter((i, t) for i, t in rows if t in good)
