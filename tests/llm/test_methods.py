"""Models and distances against plain Python, awkward tables, and the pipeline's stages against brute force in order."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from cohortlab.llm import jaccard_join, language_id, media_columns, packing, piece_encoding, quality_rules, suffix_dedup, token_counts, toxicity, url_filter
from cohortlab.llm.common import Scratch, partition_names, tokenizer_path
from tests.llm.test_operators import DATA, WORD, awkward, components, docs, empty, needs_data, removed, texts  # noqa: F401

CLASHING = "doc_id long, text string, `spans` string, `doc` long, `twin` int, `wanted0` string, `_gone` long, `c0` string, `n_chars` int"


def clashing(spark, rows):
    """Rows under column names that the operators use themselves."""
    return spark.createDataFrame([(d, t, "s", 7, 3, "w", 1, "c", len(t or "")) for d, t in rows], CLASHING)


def test_partition_names(spark):
    for parts in (1, 3, 32, 211):
        names = spark.createDataFrame([(int(n),) for n in partition_names(parts)], "n int")
        assert [r[0] for r in names.select(F.pmod(F.hash("n"), F.lit(parts))).collect()] == list(range(parts))


# Quality


def test_quality_verdict(spark, awkward):  # noqa: F811
    """Histograms, distances and verdicts in plain Python."""
    rules = quality_rules.QualityRules()
    rows = [r for r in awkward.collect() if r.doc_id is not None]
    punctuation = ".,;:!?'\"()-"

    def histogram(text):
        kinds = Counter()
        for ch in text:
            if "a" <= ch <= "z":
                kinds["lower"] += 1
            elif ch in " \t\n\x0b\x0c\r":
                kinds["space"] += 1
            elif "A" <= ch <= "Z":
                kinds["upper"] += 1
            elif "0" <= ch <= "9":
                kinds["digit"] += 1
            elif ch in punctuation:
                kinds["stop"] += 1
            elif ch.isalpha():
                kinds["other_letter"] += 1
        return [kinds[k] for k in quality_rules.CLASSES]

    def closed(counts, total):
        return [c / max(1, total) for c in [*counts, total - sum(counts)]]

    def distance(p, q):
        part = lambda v, m: v * math.log2(v / m) if v > 0 else 0.0
        return math.sqrt(min(1, max(0, sum(part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2 for x, y in zip(p, q)))))

    every = awkward.collect()
    words = lambda t: WORD.findall(t or "")
    common = lambda r: [sum(w == c for w in words(r.text)) for c in quality_rules.COMMON_WORDS.get(r.lang, [])]
    # White space within a run counts once where it separates words; the operator counts what is not in words.
    spaces = lambda t: len(t or "") - sum(map(len, words(t)))

    def classes(r):
        h = histogram(r.text or "")
        h[1] = spaces(r.text)
        h[0] = sum(map(len, words(r.text))) - sum(h[2:]) - sum(1 for ch in r.text or "" if not ("a" <= ch <= "z" or ch in " \t\n\x0b\x0c\r" or "A" <= ch <= "Z" or ch.isdigit() and ch < ":" or ch in punctuation or ch.isalpha()))
        return h

    def reference(rows):
        whole, listed = sum(len(r.text or "") for r in rows), [common(r) for r in rows]
        return closed([sum(classes(r)[i] for r in rows) for i in range(len(quality_rules.CLASSES))], whole), closed([sum(x[i] if i < len(x) else 0 for x in listed) for i in range(12)], sum(len(words(r.text)) for r in rows))

    known = {lang: reference([r for r in every if r.lang == lang]) for lang in {r.lang for r in every if r.lang}}
    all_classes = reference(every)[0]
    found = {r.doc_id: r for r in quality_rules.judge(awkward).collect() if r.doc_id is not None}
    for r in rows:
        q = found[r.doc_id]
        expected = distance(closed(classes(r), len(r.text or "")), known[r.lang][0] if r.lang else all_classes) if len(r.text or "") >= rules.min_chars else None
        assert q.class_distance == (None if expected is None else pytest.approx(expected, abs=2e-6))
        n = len(words(r.text))
        spread = distance(closed(common(r), n), known[r.lang][1]) if n >= rules.min_common_text_words and r.lang else None
        assert q.common_distance == (None if spread is None else pytest.approx(spread, abs=2e-6))
        assert q.kept == (not q.base_failed and (expected is None or expected <= rules.max_class_distance) and (spread is None or spread <= rules.max_common_distance))


def test_quality_empty(empty):  # noqa: F811
    assert quality_rules.judge(empty).count() == 0


# Language


def test_out_of_place(spark, awkward):  # noqa: F811
    """Profiles and distances by dictionaries and lists; equal counts go by code points, equal distances by name."""

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        found = Counter()
        for w in words:
            p = f" {w} "
            found.update(w)
            found.update(p[i : i + 2] for i in range(len(p) - 1))
            found.update(p[i : i + 3] for i in range(len(p) - 2) if p[i + 1] != " ")
        return found

    order = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [ord(c) for c in x[0][::-1]] if False else sum(ord(c) << 21 * i for i, c in enumerate(x[0]))))][:400]
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    learned = [r for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    profiles = {lang: order(sum((grams(r.text) for r in learned if r.lang == lang), Counter())) for lang in sorted({r.lang for r in learned})}
    found = {r.doc_id: r for r in language_id.identify(awkward, language_id.learn(awkward)).collect()}
    for r in rows:
        own = order(grams(r.text))
        if not own:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        places = {lang: {g: i for i, g in enumerate(p)} for lang, p in profiles.items()}
        far = {lang: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert found[r.doc_id].lang_pred == best and found[r.doc_id].score == pytest.approx(1 - far[best] / (400 * len(own)))


def test_language_many(spark):
    """A language with far more documents than are looked at, and more languages than any list would hold."""
    rows = [(i, "aaa bbb " * 3 if i % 2 else f"{chr(97 + i % 7)}x", "one" if i % 2 else f"l{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df, language_id.LanguageId(docs_per_language=20))
    assert len(profiles) == 1 + sum(1 for i in range(0, 600, 2) if zlib.crc32(str(i).encode()) % 4 != 2)


# Tokenizers


def test_piece_digests(awkward, empty):  # noqa: F811
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    library, sha = sentencepiece.SentencePieceProcessor(model_file=path), lambda b: hashlib.sha256(b).hexdigest()
    found = piece_encoding.encode_digests(awkward, path).collect()
    source = texts(awkward)
    assert len(found) == awkward.count()
    for r in found:
        text = source.get(r.doc_id, "no id") or ""
        ids, pieces = library.encode(text), library.encode(text, return_type="proto").pieces
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))
        assert r.spans_sha256 == sha(np.array([(p.begin, p.end) for p in pieces], "<u4").tobytes())
    assert piece_encoding.encode_digests(empty, path).count() == 0


def test_token_counts_table(awkward, empty):  # noqa: F811
    path = tokenizer_path("piece_bpe_32k.model")
    found, source, model = token_counts.count_tokens(awkward, path).collect(), texts(awkward), token_counts.counter(path)
    assert len(found) == awkward.count() and all((r.n_tokens, r.score) == model.text(source.get(r.doc_id, "no id")) for r in found)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_word_ids_are_the_library():
    """Letters whose lower case has marks of its own, combining marks, and marks at a word's end."""
    r = random.Random(8)
    model = packing.tokenizer(tokenizer_path("word_bpe_49k.json"))
    alphabet = "aB.,;$!'İıßŉक़Σς́̇éÉǅﬁ日9 \n\t-|<>"
    found = ["İ;$", "Éa.", "क़.", "aक़!b", "don't.", "<|endoftext|>", "á;"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 24))) for _ in range(4000)]
    for text, ids in zip(found, model.encode(found)):
        assert np.frombuffer(ids, "<u4").tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_awkward(spark, awkward, empty):  # noqa: F811
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(awkward, path).collect()
    model = packing.tokenizer(path)
    total = sum(len(model.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r.length for r in rows) == total and any(r.doc_id is None for r in rows)
    assert packing.pack(empty, path).count() == 0


def test_packing_fills_by_the_rule():
    """With min_documents remainders, most lie in windows that the rule itself filled."""
    r = random.Random(1)
    state, names, sizes = packing.SumOfSquares(2048), iter(range(10**6)), []
    held: dict[int, int] = {}
    for _ in range(packing.Packing().min_documents):
        size = min(2047, int(r.lognormvariate(5.6, 0.9)) + 1)
        window, level = state.place(size, lambda: next(names))
        held[window] = level + size
        sizes.append((window, size))
    assert sum(s for w, s in sizes if held[w] == 2048) / sum(s for _, s in sizes) > 0.6


# Near copies


def test_sketches_never_overrate():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.r_[x[: r.integers(0, len(x) + 1)], r.integers(0, 2**63, r.integers(1, 90), dtype=np.uint64)])
        assert jaccard_join.least_distance(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(x) + len(y) - 2 * len(np.intersect1d(x, y))


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    r = random.Random(5)
    found = ["".join(r.choice(["a", "B", "é", " ", "\t", "xyz", "日"]) for _ in range(200)) for _ in range(20)] + ["w" * 3000 + " x", None, ""]
    whole = jaccard_join.shingle_sets(found, 3)
    monkeypatch.setattr(jaccard_join, "CHUNK", 64)
    jaccard_join._powers.cache_clear()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, jaccard_join.shingle_sets(found, 3)))
    jaccard_join._powers.cache_clear()


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_chains(spark, width, percent):
    """Groups larger than ``small`` whose members are linked in chains and not with their leader, and tokens that fill batches."""
    r = random.Random(2)
    rows = []
    for g in range(4):
        vocab = [f"g{g}w{i}" for i in range(60)]
        words = [r.choice(vocab) for _ in range(120)]
        for step in range(40):
            words = words[:]
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append(" ".join(words))
    rows = list(enumerate(rows))
    options = jaccard_join.JaccardJoin(width=width, percent=percent, rare=3, hot=6, small=4)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), options).collect()}
    assert found == components(dict(rows), width, percent)


def test_jaccard_far_documents(spark, monkeypatch):
    """Documents that share a passage with their leader and little else do not list the leader's tokens; links among them stay."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(45)]
    rows = [passage + [f"w{r.randrange(10**9)}" for _ in range(90)] for _ in range(80)]
    rows += [words[:-2] + ["other", "end"] for words in rows[10:14]]
    rows = dict(enumerate(" ".join(words) for words in rows))
    made, join = [], DataFrame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if repr(on) == repr(["lead", "token"]) and "c" in other.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", counted)
    options = jaccard_join.JaccardJoin(width=5, percent=80, rare=6, hot=8, small=4)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), options).collect()}
    assert found == components(rows, 5, 80) and found[80][1] == 10
    assert made and sum(made) < 10 * len(rows)  # of some 90 tokens of the leader's for each document


@pytest.mark.parametrize("percent, spare", [(80, 2), (80, 12), (90, 5)])
def test_jaccard_far_lists(spark, percent, spare):
    """Documents far from their leader list a part of their own tokens, and no link with or among them is lost."""
    r = random.Random(percent + spare)
    draw = lambda k: {r.getrandbits(64) - (1 << 63) for _ in range(k)}
    some = lambda s, k: set(r.sample(sorted(s), min(len(s), k)))
    sets, told = {}, []
    for lead in range(0, 3000, 1000):
        center, passage = draw(150), draw(30)
        sets[lead] = center
        docs = []
        for cluster in range(12):
            # From far away, with a passage that many of them have, to about as far from the leader as a link allows.
            base = some(center, 12 * cluster + 10) | draw(140 - 12 * cluster) | (set() if cluster % 2 else passage)
            docs += [some(base, len(base) - r.randrange(7 * (100 - percent) // 5)) | draw(r.randrange(100 - percent)) for _ in range(10)]
        for i, own in enumerate(docs, lead + 1):
            sets[i] = own
            near = (100 + percent) * len(own ^ center) <= (100 - percent) * (len(own) + 150)
            told.append((lead, i, lead if near else i, not near))
    linked = set()
    for lead, a, x, p in told:
        for other, b, y, q in told:
            if a < b and lead == other and x != y and (p or q) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                linked.add((a, b))
    options = jaccard_join.JaccardJoin(percent=percent, rare=6, spare=spare)
    items = [(i, sorted(s, key=lambda x: x % (1 << 64))) for i, s in sets.items()]
    differences = jaccard_join._differences(spark.createDataFrame(told, "lead long, rep long, label long, loose boolean"), spark.createDataFrame(items, "rep long, items array<long>"))
    listed = jaccard_join._listed(differences, options).cache()
    far = listed.where("far").agg(F.count("*"), F.sum(F.size("own")), F.sum("w"), F.sum(F.size("lost"))).first()
    assert far[0] > 100 and far[1] < 0.6 * far[2] and far[3] == 0
    own = jaccard_join._held(listed.select("lead", "rep", F.explode("own").alias("token")))
    found = {tuple(x) for x in jaccard_join._second_pairs(jaccard_join._difference_entries(listed, own, options), options).collect()}
    assert len(linked) > 300 and linked <= found
    kinds = {x.rep: x.far for x in listed.collect()}
    assert {kinds[a] + kinds[b] for a, b in linked} >= ({1, 2} if percent == 80 else {2})


def test_jaccard_repeated_ids(spark):
    """An id with two texts connects what either is equal to; other columns' names do not matter."""
    a, b = "one two three four five six seven eight nine ten " * 3, "alpha beta gamma delta epsilon zeta eta theta " * 4
    df = clashing(spark, [(5, a), (5, b), (7, b), (9, a), (11, "other words here"), (11, "other words here"), (None, a), (None, None), (12, None)])
    options = jaccard_join.JaccardJoin(width=3, percent=90)
    found = {(r.doc_id, r.component_id) for r in jaccard_join.link(df, options).collect()}
    assert found == {(5, 5), (7, 5), (9, 5), (11, 11), (None, None), (12, 12)}
    kept = jaccard_join.one_of_each(df, options)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["11", "12", "5", "None", "None"]


# Repeated passages


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_short(spark, parts):
    """Texts of the window's length and a little more, fewer rows than partitions, and none that share anything."""
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    base = letters(107)
    for rows in ([(1, letters(50))], [(1, letters(52)), (2, letters(52))], [(i, letters(50 + i % 5)) for i in range(20)], [(1, base), (2, base[:89]), (3, "x" + base[7:])],
                 [(i, letters(30) + base[:60] + letters(i)) for i in range(12)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digests(df).collect()}
        assert found == removed(dict(rows))


def test_suffix_repeated_ids(spark):
    """Two texts of one id: each loses what it shares with smaller ids, and nothing by the other's spans."""
    r = random.Random(10)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b = letters(107), letters(107)
    rows = [(1, a), (5, a), (5, b), (6, b), (6, b)] + [(100 + i, letters(90)) for i in range(30)] + [(None, a)]
    df = clashing(spark, rows)
    found = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in suffix_dedup.digests(df).collect() if x.doc_id is None or x.doc_id < 100)
    assert found == [("1", 107, 0), ("5", 107, 0), ("5", 107, 107), ("6", 107, 107), ("6", 107, 107), ("None", 107, 0)]
    kept = suffix_dedup.without_repeats(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted((r.text, r.n_chars) for r in kept.collect() if r.doc_id == 5) == sorted([("", 0), (b, 107)])
    assert {(r.spans, r.doc, r.twin, r.wanted0, r.c0) for r in kept.collect()} == {("s", 7, 3, "w", "c")}


def test_suffix_long(spark):
    """Long repetitive texts, and a passage that every other document holds."""
    r = random.Random(11)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(r.choice("ab ") for _ in range(40)) + (passage if i % 2 else "") + "the same words again and again, " * (2 + i % 3) * (40 if i == 3 else 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digests(df).collect()} == removed(dict(rows))


# URLs


def test_trees_by_hand(spark):
    """The expression of the trees, and the suffix rates of the other folds, in plain Python."""
    urls = [f"http://{'win-9' if i % 3 == 0 else 'site'}.s{i % 5}/{'a/' * (i % 4)}x{i}?k={i}" for i in range(120)]
    df = spark.createDataFrame([(i, u, i % 3 == 0 if i % 2 else None) for i, u in enumerate(urls)], "page_id long, url string, mark boolean")
    rows = url_filter.lexical(df, "page_id").join(df.select("page_id", F.col("mark").cast("int").alias("label")), "page_id")
    options = url_filter.Boosting()
    rows = url_filter.with_suffix_statistics(rows, url_filter.suffix_statistics(rows, "page_id", options), "page_id", options)
    model = url_filter.train(rows.where("label is not null"))

    def walk(tree, row):
        while not isinstance(tree, float):
            feature, threshold, left, right = tree
            tree = left if row[feature] <= threshold else right
        return tree

    found = rows.withColumn("margin", model.column()).collect()
    labels = {r.page_id: r.label for r in found}
    known = [v for v in labels.values() if v is not None]
    prior = (sum(known) + 1) / (len(known) + 2)
    for r in found:
        assert r.margin == pytest.approx(model.base + sum(walk(t, r) for t in model.trees))
        fold = lambda i: zlib.crc32(str(i).encode()) % 5
        others = [v for i, v in labels.items() if i % 5 == r.page_id % 5 and v is not None and (r.label is None or fold(i) != fold(r.page_id))]
        assert r.suffix_block_rate == pytest.approx((sum(others) + 10 * prior) / (len(others) + 10), abs=1e-6)
        assert r.suffix_share == pytest.approx(24 / 120, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_urls(spark):
    """Labelled URLs of a fold that the trees never saw."""
    from cohortlab.llm.queries import URL_RULES

    options = url_filter.Boosting()
    rows = url_filter.lexical(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), "page_id")
    rows = rows.withColumn("rule", url_filter.rule_column(URL_RULES, F.col("host"), F.col("path")))
    verdict = F.create_map(*[F.lit(x) for pair in URL_RULES.items() for x in pair])[F.col("rule")]
    rows = rows.withColumn("truth", F.when(verdict == "block", 1).when(verdict == "allow", 0)).withColumn("label", F.when(F.col("page_id") % 4 != 0, F.col("truth")))
    rows = url_filter.with_suffix_statistics(rows, url_filter.suffix_statistics(rows, "page_id", options), "page_id", options).cache()
    model = url_filter.train(rows.where("label is not null"))
    found = rows.where("truth is not null and page_id % 4 = 0").select("truth", (model.column() > 0).cast("int").alias("told")).collect()
    assert len(found) > 100 and sum(r.truth == r.told for r in found) / len(found) > 0.8


def test_long_urls(spark):
    urls = ["http://a.example.com/en/7" + "x" * 100_000, "http://" + "b." * 5000 + "net/de/", None]
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow"}
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0])], "page_id long, url string"), rules).collect()}
    assert found[0] == found[None] == ("example.com/en/7", "allow") and found[1] == ("net/de/", "allow") and found[2][0] is None


# Toxicity


def plain_score(model, text):
    """A document's score by the definition, segment search by its recursion."""
    marks = toxicity.MARKS
    scores = []
    for token in (text or "").lower().split():
        word = token.strip(marks)
        weight = model.weights.get(word)
        if weight is None:
            weight = next((model.weights["^" + word[:n]] for n in reversed(model.prefixes) if len(word) >= n and "^" + word[:n] in model.weights), 0.0)
        scores.append(weight - model.drift)

    def segments(s):
        best, where, low, at = 0.0, None, 0.0, 0
        total = 0.0
        for j, x in enumerate(s):
            total += x
            if total - low > best + 1e-12:
                best, where = total - low, (at, j + 1)
            if total < low:
                low, at = total, j + 1
        if where is None:
            return []
        return [*segments(s[: where[0]]), best, *segments(s[where[1] :])]

    evidence = share = 0.0
    if scores:
        level = model.log_k + math.log(len(scores))
        found = [model.lam * s - level for s in segments(scores)]
        floor = -math.log(model.max_expected)
        evidence = sum(x for x in found if x > floor) or min(0.0, max(found, default=0.0))
        share = evidence / len(scores)
    root = lambda x: math.copysign(math.sqrt(abs(x)), x)
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * root(evidence) + c * root(share)))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_toxicity_by_hand(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(d, labels)
    short = d.where("length(text) < 3000 or text is null")
    source = texts(short)
    rows = toxicity.score(short, model).collect()
    for r in rows[:300]:
        assert r.score == pytest.approx(plain_score(model, source[r.doc_id]), abs=1e-9)
        assert r.predicted == (r.score >= 0.3)


def test_toxicity_repeated(spark):
    rows = [(i % 30, f"{'bad awful' if i % 30 < 10 else 'good fine'} word{i % 7} text") for i in range(120)]
    df = clashing(spark, rows + [(None, "bad"), (40, None), (41, "")])
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i in range(30)] + [(3, 1, 1), (50, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels, toxicity.Toxicity(min_z=0.5))
    assert toxicity.labelled(df, labels, toxicity.Toxicity()).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(30))
    scored = toxicity.score(df, model).collect()
    assert len(scored) == 123
    kept = toxicity.without_toxic(df, model, 0.3)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in scored)


# Media


def test_feature(awkward):  # noqa: F811
    source = texts(awkward)
    for r in media_columns.document_media(awkward.where("doc_id is not null"), Scratch(awkward.sparkSession, "media")).collect():
        data = (source[r.doc_id] or "").encode()
        data += b"\xff" * (-len(data) % 576 if data else 576)
        mean = sum(data) / len(data)
        deviation = math.sqrt(max(0.0, sum(x * x for x in data) / len(data) - mean * mean))
        shares = [sum(x >> 4 == i for x in data) * 1000 // len(data) for i in range(16)]
        head, m, s, rest = re.match(r"(\d+x\d+);mean=([\d.]+);sd=([\d.]+);(.*)", r.feature).groups()
        assert head == f"576x{len(data) // 576}" and float(m) == pytest.approx(mean, abs=1e-4) and float(s) == pytest.approx(deviation, abs=1e-3)
        assert rest == "-".join(map(str, shares))


# Pipeline


@needs_data
def test_stages_in_order(spark, docs, tmp_path):  # noqa: F811
    """Every stage against brute force on what the stage before kept; some rows are empty, null, long or repeated."""
    import corpus_pipeline

    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 30_000), (10**6 + 3, "12 34"), (None, "the people of the town went to the river and the house")]
    some = docs.unionByName(spark.createDataFrame([(d, t, None, "odd", len(t or "")) for d, t in odd], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    keep = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())

    def step(name, df):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, df, DATA).write.parquet(path)
        return spark.read.parquet(path)

    clean = step("toxicity", some)
    model = toxicity.learn(some, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert keep(clean) == sorted((str(r.doc_id), r.text or "") for r in some.collect() if plain_score_long(model, r.text) < 0.3)
    known = step("language ID", clean)
    told = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(clean, language_id.learn(clean)).collect()}
    good = {d for d, lang, s in told if lang != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert {r.doc_id for r in known.collect()} == good and known.columns == docs.columns
    single = step("n-gram Jaccard join", known)
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == {c for _, c in components(texts(known), 5, 80).values()}
    cut = step("suffix-array dedup", single)
    short = {d: t for d, t in texts(single).items()}
    expected = removed(short)
    for r in cut.collect():
        if r.doc_id is not None:
            assert r.n_chars == len(r.text or "")
            if expected[r.doc_id][1] == 0:
                assert (r.text or "") == (short[r.doc_id] or "")
    lost = {r.doc_id for r in cut.collect() if r.doc_id is not None and (r.text or "") != (short[r.doc_id] or "")}
    assert lost == {d for d, x in expected.items() if x[1]}
    packed = step("packing", cut).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in cut.collect()}
    windows = Counter()
    for r in packed:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 2048 and sum(v < 2048 for v in windows.values()) <= 1


def plain_score_long(model, text):
    """As plain_score, with the operator's own segment search, which is tested by itself, for long texts."""
    scores = model.scores(toxicity.tokens_of(text))
    return model.probability(*model.evidence(scores)) if len(scores) > 400 else plain_score(model, text)


def test_media_size():
    """A picture of plain prose takes little more than its text deflated well."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    payload = media_columns.payload_of(" ".join(r.choice(words) for _ in range(3000)))[0]
    assert len(media_columns.write_png(payload)) < 1.02 * len(zlib.compress(payload, 6)) + 100
