"""Text operators against brute force on small tables, with the odd rows every operator must bear."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from minutebook.llm import minhash, mixing, packing, quality, substring, toxicity

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(WORDS[zlib.crc32(f"{seed}/{i}".encode()) % len(WORDS)] for i in range(n))


BASE = prose("base", 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
PASSAGE = prose("passage", 45)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, BASE, "en", "a"), (2, NEAR, "en", "a"), (3, BASE, "en", "b"), (3, BASE, "en", "b"), (4, None, "en", "b"),
            (5, "", None, None), (6, " \t\n ", "en", None), (None, "no id here", "en", "a"),
            (7, prose("x", 30) + " " + PASSAGE + " " + prose("y", 30), "en", "a"),
            (8, prose("z", 25) + "\n" + PASSAGE + "\x0b" + prose("q", 5), "de", "c"),
            (9, "de " * 90, "de", "c"), (10, prose("long", 30_000), "en", "a"), (11, "three short words", "en", "a"),
            (12, "three short words", "en", "a"), (13, "naïve Straße été ünïcode", "de", "c")]
    # column names that operators might use themselves
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
            .withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("s")).withColumn("n_words", F.lit(7))
            .withColumn("_id", F.lit(1.5)).withColumn("mix", F.lit("m")).withColumn("class_id", F.lit(-1)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def cells(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    runs = [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    return {(r, k) for r, c in collections.Counter(runs).items() for k in range(c)}


def classes_of(rows, similarity=0.8):
    """Least id reachable by links, by comparing all pairs."""
    sets = [(i, cells(t)) for i, t in rows if i is not None]
    best = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets
             if a and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-12]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if best[i] != best[j]:
                best[i] = best[j] = min(best[i], best[j])
                moved = True
    return best


def test_near_duplicates_equal_brute_force(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    want = classes_of([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    assert all(r.class_id == want.get(r.doc_id) for r in got)
    assert want[2] == want[3] == 1 and want[12] == 11 and want[4] == 4 and want[6] == 6
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicate_families_across_blocks(spark):
    """A family larger than a block, a few changed words per text, and texts that share only half."""
    words = prose("family", 150).split()
    rows = []
    for k in range(60):
        own = list(words)
        for j in range(k % 7):
            own[zlib.crc32(f"{k}.{j}".encode()) % 150] = f"new{k}.{j}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(words[:75]) + " " + prose(f"other{k}", 75)) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table, block=8).collect()}
    assert got == classes_of(rows)


def test_keep_one_leaves_columns_and_rows_without_words(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 3 not in ids and 12 not in ids and {1, 4, 5, 6, 11, None} <= set(ids)


def test_signatures_agree_as_often_as_texts_are_alike():
    a, b = BASE.encode(), (" ".join(BASE.split()[:90]) + " " + prose("end", 30)).encode()
    s = minhash.signatures([a, b, b""], size=2000)
    x, y = cells(a.decode()), cells(b.decode())
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.05
    assert (s[2] == 0).all() and (s[:2] != 0).all()


def repeats(rows, window=20):
    seen, out = set(), collections.defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                gone[k:k + window] = [True] * window
            seen.add(key)
        text = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i].append((len(words), sum(gone), hashlib.sha256(text).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def grouped(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    return {i: sorted(v) for i, v in out.items()}


def test_repeats_equal_brute_force(docs, empty):
    want = repeats([(r.doc_id, r.text) for r in docs.collect()])
    for size in (1, 4, 1000):
        assert grouped(substring.remove_repeats(docs, segment_rows=size).collect()) == want
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_across_factor_ends(spark):
    """A passage whose halves stand in two earlier texts, a text that repeats itself, and runs of one word."""
    left, right = prose("left", 60), prose("right", 60)
    rows = [(1, left), (2, right), (3, " ".join(left.split()[-30:] + right.split()[:30])),
            (4, " ".join([prose("self", 25)] * 3)), (5, "a " * 21 + "b " * 21 + "a " * 30), (6, left + " " + right)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(table, segment_rows=2, with_text=True).collect()
    assert grouped(got) == repeats(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].kept_text == left and by_id[6].n_removed == 120
    assert [(s.start, s.length) for s in by_id[3].spans] == [(0, 30), (30, 30)]


def test_packing_is_an_exact_round_trip(docs, empty, tokenizer):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(tokenizer)
    pieces = packing.pack(docs, tokenizer, length=64).collect()
    stream = {}
    for p in pieces:
        stream[p.sequence_id * 64 + p.offset] = p
    at, texts = 0, collections.Counter()
    want = collections.Counter()
    for r in docs.collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(r.doc_id, tuple(ids))] += 1
    open_doc = []
    while at in stream:
        p = stream.pop(at)
        open_doc.append(p)
        assert p.length > 0 and p.offset + p.length <= 64
        at += p.length
        if p.start + p.length == p.doc_tokens:
            found = [k for k in want if k[0] == p.doc_id and len(k[1]) == p.doc_tokens and all(
                zlib.crc32(b"".join(i.to_bytes(4, "little") for i in k[1][q.start:q.start + q.length])) == q.ids_crc32 for q in open_doc)]
            assert found and open_doc[0].start == 0 and sum(q.length for q in open_doc) == p.doc_tokens
            texts[found[0]] += 1
            open_doc = []
    assert not stream and texts == want
    assert packing.pack(empty, tokenizer).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer, length=0)


def test_encoder_equals_tokenizer(tokenizer):
    texts = ["İstanbul ΑΣ Σ's don't I'LL 12 a1b2 <|endoftext|> x<|startoftext|>", "é a b \x1cx \x85y", "", "'s", "it's--ok!!'re 're",
             "ﬁ Ǆ ß ẞ ŉ ſ", "naïve’s “q” … — 日本語 テスト", "ȧ İ", "x.y,z don't.stop ''' '", "º ª ¼ ² ½a", "ÿ÷×ð ÷ þa× µ", " \n ",
             "mail@x.org 4!!", "éa", prose("tok", 50)]
    coder = packing.Encoder(tokenizer, most=20)
    assert coder.encode([t.encode() for t in texts]) == [coder.whole(t) for t in texts]


def schedule(shares, slots):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(shares.values()), dict.fromkeys(shares, 0), {}
    for t in range(slots):
        due, name = min((-(-(done[s] + 1) * total // w), s) for s, w in shares.items() if done[s] * total // w <= t)
        out[name, done[name]] = (t, done[name] * total // shares[name], due)
        done[name] += 1
        assert t < due and all(abs(done[s] - (t + 1) * w / total) < 1 for s, w in shares.items())
    return out


def test_mixture_equals_slot_by_slot_schedule(docs, empty):
    shares = {"a": 5, "b": 2, None: 3}
    got = mixing.mix(docs, shares, block=16, chunk_rows=2, into="place").collect()
    assert len(got) == docs.count()
    plan = schedule({"a": 5, "b": 2, "": 3, "c": 1}, max(r.place.slot for r in got) + 1)
    order = {"a": "a", "b": "b", None: "", "c": "c"}
    for r in got:
        # equal deadlines go to the source that sorts first, null before all
        assert plan[order[r.source], r.place.block] == (r.place.slot, r.place.release, r.place.deadline)
    for name in order:
        rows = sorted((r.place.start, r.n_chars or 0) for r in got if r.source == name)
        assert all(rows[k][0] == sum(n for _, n in rows[:k]) for k in range(len(rows)))
    assert mixing.mix(empty, into="place").count() == 0
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs).count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0}, into="place")
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 20_000}, into="place").count()
    with pytest.raises(ValueError):
        mixing.mix(docs)


def labelled_corpus(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = prose(f"doc{k}", 20 + k % 50)
        rows.append((k, text + (" you scumbag idiot " + prose(f"more{k}", 20) if bad else ""), "m"))
        labels.append((k, int(k % 3 > 0), int(bad)))
        if k % 3 == 0:
            rows[-1] = (k, "buy now " * 12, "m") if not bad else rows[-1]
    rows += [(1000, None, "m"), (1001, "", "m"), (None, "plain words", "m")]
    labels += [(1, None, None), (None, 1, 1), (2, 7, 9)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("score, fold, folds, label, bar", [
    (toxicity.score_toxicity, 0, 5, "toxic", 0.5), (quality.score_quality, 2, 4, "quality", 0.7)])
def test_classifiers_on_held_out_rows(spark, score, fold, folds, label, bar):
    table, labels = labelled_corpus(spark)
    got = score(table, labels, fit_rows=150).collect()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] in (0, 1)}
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.predicted == int(r.score >= bar)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    if label == "toxic":
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    alone = score(table, labels.limit(0)).collect()
    assert len({r.score for r in alone}) == 1
    assert score(table.limit(0), labels).count() == 0


def test_factorized_pairs_equal_all_pairs():
    import numpy as np
    rng = np.random.default_rng(1)
    text, feature, value = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 1, 3]), rng.normal(size=5)
    weight, factors = rng.normal(size=4), rng.normal(size=(3, 4))
    got, _ = quality._margin(2, text, feature, value, 0.5, weight, factors)
    for t in (0, 1):
        at = np.flatnonzero(text == t)
        pairs = sum(factors[:, feature[i]] @ factors[:, feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert abs(got[t] - (0.5 + weight[feature[at]] @ value[at] + pairs)) < 1e-9


def test_toxic_stretch_counts_wherever_it_stands():
    texts = [(prose(f"t{k}", 60) + (" scumbag idiot " if k % 2 else " ")).encode() for k in range(200)]
    import numpy as np
    model = np.frombuffer(toxicity.fit(texts, [k % 2 for k in range(200)], [0.5] * 200), "<f4")
    long = prose("long", 8000)
    clean, early, late = toxicity.scores([long.encode(), ("scumbag idiot " + long).encode(), (long + " scumbag idiot").encode()], model)
    assert clean < 0.5 < min(early, late)


def test_large_clusters_reach_no_group_whole(spark, monkeypatch):
    """One hot family and texts that hang on it by half their words: groups stay at a few blocks, classes exact."""
    words, solve = prose("hot", 60).split(), minhash._forest
    rows = []
    for k in range(300):
        own = list(words)
        own[zlib.crc32(f"{k}".encode()) % 60] = f"new{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(words[:45]) + " " + prose(f"hang{k}", 15)) for k in range(20)]
    rows += [(2000 + k, " ".join(words[:45]) + " " + prose("hang3", 14) + f" end{k}") for k in range(10)]

    def small_only(n, similarity):
        run = solve(n, similarity)

        def checked(part):
            assert part.num_rows <= 8 * 8, f"{part.num_rows} texts in one group"
            return run(part)
        return checked

    monkeypatch.setattr(minhash, "_forest", small_only)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert got == classes_of(rows)


def test_repeated_id_keeps_its_other_text(spark):
    """Only the row whose own text stands under a smaller id is a copy, not every row of its id."""
    rows = [(3, BASE), (5, BASE), (5, prose("unique", 60)), (None, PASSAGE), (9, PASSAGE), (9, prose("alone", 40))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2, 1000):
        assert grouped(substring.remove_repeats(table, segment_rows=size).collect()) == repeats(rows)
