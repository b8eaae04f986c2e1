"""The training-data operators against brute force, libraries and round trips, and on awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import (
    jaccard_join, language_id, media_columns, packing, piece_encoding, quality_rules, suffix_dedup, token_counts, toxicity, url_filter,
)
from cohortlab.llm.common import Scratch, tokenizer_path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rule string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    r = random.Random(7)
    words = [" ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(r.randint(0, 60))) for _ in range(25)]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 4
    odd = [None, "", " ", "\n\n", "x", "é" * 60, "a" * 5000, base, base, base + "tail", "IDIOT\tx\x00y ▁▁ <s> <|endoftext|>", "日本語 " * 40, "word " * 20_000]
    return [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", "s", 0, 1.0, "z") for i, t in enumerate(odd + words)]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = awkward_rows()
    return spark.createDataFrame(rows + rows[7:9] + [(None, "no id", "en", None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.where("doc_id is not null").select("doc_id", "text").collect()}


# Quality rules


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["awkward", pytest.param("docs", marks=needs_data)])
def test_quality_base(request, name):
    df = request.getfixturevalue(name)
    found = quality_rules.judge(df)
    assert found.count() == df.count()
    source = texts(df)
    for r in found.where("doc_id is not null").collect():
        assert tuple(r)[1:6] == base_counts(source[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_js_distance(spark):
    row = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5], [0.5, 0.5, 0.0])], "p array<double>, q array<double>, s array<double>")
    d, zero = row.select(quality_rules.js_distance(F.col("p"), F.col("q")), quality_rules.js_distance(F.col("p"), F.col("s"))).first()
    assert d == pytest.approx(0.5**0.5) and zero == 0


@needs_data
def test_quality_keeps_good(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rates = {r.quality: r.k for r in quality_rules.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.9 and rates[0] < 0.5


# Language


@needs_data
def test_language(spark, docs):
    found = language_id.identify(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_language_awkward(awkward, empty):
    found = {r.doc_id: r for r in language_id.identify(awkward, language_id.learn(awkward)).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[3].lang_pred == "und" and found[7].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0


def test_ngrams():
    keys, counts = language_id.ngrams("Ab, ab")
    shown = {"".join(chr(k >> s & 0x1FFFFF) for s in (0, 21, 42) if k >> s & 0x1FFFFF): n for k, n in zip(keys.tolist(), counts.tolist())}
    assert shown == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}


# Tokenizers


def samples():
    r = random.Random(1)
    odd = ["", " ", "a\n\nb", "▁▁a", "<s><0x41>", "é́ 日本語 😀  \t x\x00y", "a" * 3000, "the" * 400 + " " * 50, "it's I'M", "<|endoftext|>x", "x\x1cy \x1f z", "ΑΣ Σ é", " lead", None]
    return odd + ["".join(r.choice("ab \n\t▁'sé日😀.<|>0x,") for _ in range(r.randint(0, 80))) for _ in range(300)]


def test_piece_encoding_is_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.encoder(path)
    decoder = piece_encoding.Decoder(mine)
    for t in samples():
        ids = library.encode(t or "")
        shown, spans = mine.encode_text(t)
        assert shown == ",".join(map(str, ids))
        assert decoder.decode(shown).decode() == mine.decode(ids) == library.decode(ids)
        pieces = library.encode(t or "", return_type="proto").pieces
        assert spans.tolist() == [[p.begin, p.end] for p in pieces]
        assert [(p.id, p.begin, p.end) for p in mine.encode_spans(t)] == [(p.id, p.begin, p.end) for p in pieces]


def test_character_map():
    """A trie of two entries, a -> x and ab -> yz, laid out by hand."""
    units = [0] * 1024
    offset = lambda to, at: (to ^ at) << 10
    units[0] = offset(256, 0)
    a = 256 ^ 97
    units[a] = offset(512, a) | 97 | 1 << 8
    units[512] = 0 | 1 << 31
    ab = 512 ^ 98
    units[ab] = offset(768, ab) | 98 | 1 << 8
    units[768] = 2 | 1 << 31
    blob = np.array([4 * len(units)] + units, "<u4").tobytes() + b"x\0yz\0"
    table = piece_encoding.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (b"yz", 2) and table.longest(b"ac", 0) == (b"x", 1) and table.longest(b"b", 0) is None
    model = piece_encoding.Model(["<unk>"], [2], [0.0], table, True, True, True)
    assert piece_encoding.Encoder(model).normalise("  ab a ") == ("▁yz▁x", [2, 2, 2, 2, 2, 4, 4, 4, 5, 6])


def test_unigram_counts_are_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", min(s for _, s in vocab)), *vocab], 0, False))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always")
    mine = token_counts.counter(path)
    for t in samples() + ["𐍈𐍈𐍉 a"]:
        assert mine.text(t)[0] == len(library.encode(t or "", add_special_tokens=False).ids)


def test_unigram_ties():
    mine = token_counts.Counter([("▁a", -1.0), ("b", -1.0), ("▁ab", -2.0), ("▁", -1.0), ("a", 0.0)])
    assert mine.word("▁ab") == (1, -2.0)


# Packing


def test_packing(awkward):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), path, carry_ids=True).collect()
    model = packing.tokenizer(path)
    expected = {d: b"".join(int(i).to_bytes(4, "little") for i in [*model.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts(awkward).items()}
    windows, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
        windows[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for held in windows.values():
        ends = [0] + list(np.cumsum([n for _, n in sorted(held)]))
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    for doc, parts in whole.items():
        joined = b"".join(p for _, p, _ in sorted(parts))
        assert joined == expected[doc] and {n for _, _, n in parts} == {len(joined) // 4}
    assert set(whole) == set(expected)


def test_sum_of_squares_choice():
    r = random.Random(3)
    state, names = packing.SumOfSquares(16), iter(range(10_000))
    for _ in range(2000):
        size = r.randint(1, 15)
        levels = state.levels.tolist()
        cost = {}
        for h in range(0, 17 - size):
            if h and not levels[h]:
                continue
            after = levels[:]
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            cost[h] = sum(x * x for x in after[1:16])
        assert cost[state.choose(size)] == min(cost.values())
        state.place(size, lambda: next(names))


# Near copies


def components(source, width, percent):
    sets = {}
    for d, t in source.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def near_copies():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [r.choice(vocab) for _ in range(r.choice([12, 40, 90, 150, 200]))]
        for _ in range(30):
            words = base[:]
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                words += [r.choice(vocab) for _ in range(r.randint(1, 6))]
            rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, width, percent):
    rows = list(enumerate(near_copies()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(df, jaccard_join.JaccardJoin(width=width, percent=percent, rare=3)).collect()}
    assert found == components(dict(rows), width, percent)


def test_jaccard_awkward(awkward, empty):
    options = jaccard_join.JaccardJoin(width=3, percent=90)
    found = jaccard_join.link(awkward, options).collect()
    assert len(found) == awkward.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == components(texts(awkward), 3, 90)
    assert jaccard_join.link(empty, options).count() == 0
    kept = jaccard_join.one_of_each(awkward, options)
    assert kept.columns == awkward.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id = 8").count() == 0


# Repeated passages


def removed(source):
    first = {}
    for d in sorted(source):
        b = (source[d] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in source.items():
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                mask[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, mask) if not y)
        out[d] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, awkward, empty):
    r = random.Random(5)
    base = ["".join(r.choice("aé\x00b ") for _ in range(120)) for _ in range(6)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 40) : r.randint(60, 120)] for _ in range(r.randint(0, 4)))) for i in range(60)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), awkward.where("length(text) < 9000 or text is null")):
        found = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digests(df).where("doc_id is not null").collect()}
        assert found == removed(texts(df))
    assert suffix_dedup.digests(empty).count() == 0


def test_run_length_index():
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(6, 30))).encode() for _ in range(60)]
    words = sorted(set(words))
    index = suffix_dedup.RunLengthIndex([w * 4 for w in words], np.arange(len(words)), 50)
    assert len(index.starts) < index.rows and len(index.blocks) < index.rows
    found = {(t, p): v for t, p, v in zip(*(x.tolist() for x in index.stream()))}
    assert found
    for (t, p), v in found.items():
        string = (words[t] * 4)[p : p + 50]
        assert v == min(i for i, w in enumerate(words) if string in w * 4)


# Toxicity


def brute_segments(scores):
    """Maximal segments by the definition's recursion: the best-scored segment, then both sides of it."""
    best, where = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12:
                best, where = s, (i, j)
    if where is None:
        return []
    i, j = where
    return [*brute_segments(scores[:i]), (i, j), *[(a + j, b + j) for a, b in brute_segments(scores[j:])]]


def test_maximal_segments():
    r = random.Random(4)
    for _ in range(60):
        scores = np.array([r.choice([-3, -2, -1, 1, 2, 3]) + r.random() / 100 for _ in range(r.randint(0, 18))])
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == brute_segments(list(scores))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(d, toxicity.learn(d, labels)).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((b > g) + (b == g) / 2 for b in bad for g in good)
    assert wins / (len(bad) * len(good)) > 0.75


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(awkward, none)
    found = toxicity.score(awkward, model, with_segments=True).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0


# URLs


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow"}


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/77?x=1", "https://b.com/en/9#t", "x://com/en/", "http://net/de", "http://q.net/de/1", "http://notcom/en/1", "ftp://h?x=/en/", "plain/com/en/", "", None, "http://É.COM/en/ü", "a://b://com/en/", "http://x.org/fr/1"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls * 3)], "page_id long, url string, host string, label int")
    found = url_filter.judge(df, RULES).collect()
    assert len(found) == len(urls) * 3
    for r in found:
        host, path = split_url(urls[r.page_id % len(urls)])
        fits = [k for k in RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("block", "allow") and (rule is None or r.verdict == RULES[rule])
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_boosting_learns(spark):
    r = random.Random(6)
    rows = [(i, f"http://{'cheap-win-99' if i % 2 else 'site'}.{r.choice(['org', 'net'])}/{'/'.join('ab' for _ in range(r.randint(1, 3)))}", i % 2) for i in range(300)]
    df = url_filter.lexical(spark.createDataFrame(rows, "page_id long, url string, label int"), "page_id").withColumns({"suffix_share": F.lit(0.0), "suffix_block_rate": F.lit(0.5), "label": (F.col("page_id") % 2).cast("int")})
    model = url_filter.train(df)
    assert df.where(((model.column() > 0).cast("int")) != F.col("label")).count() == 0


# Media


def test_media_round_trip(spark, awkward, empty):
    found = media_columns.document_media(awkward, Scratch(spark, "media")).where("doc_id is not null").collect()
    source = texts(awkward)
    for r in found:
        data = (source[r.doc_id] or "").encode()
        padded = data + b"\xff" * ((-len(data) % 576) if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        media = media_columns.write_png(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and media_columns.read_png(media)[0] == padded
    assert media_columns.document_media(empty, Scratch(spark, "media")).count() == 0


def test_sequences():
    html = "<p>One &amp; two</p><figure><img src='media/%s.png' alt='x'><figcaption>Cap <b>tion</b></figcaption></figure>after<script>no</script><img src='u.png' alt='alt'>" % ("a" * 64)
    found = media_columns.sequence(html)
    assert [(s["kind"], s["text"] or s["src"], s["caption"]) for s in found] == [("text", "One & two", None), ("media", f"media/{'a' * 64}.png", "Cap tion"), ("text", "after", None), ("media", "u.png", "alt")]
    assert [s["position"] for s in found] == [0, 1, 2, 3] and found[1]["digest"] == "a" * 64 and found[3]["digest"] is None
    assert media_columns.sequence(None) == [] and media_columns.sequence("") == []


def test_media_is_stored(spark, awkward):
    scratch = Scratch(spark, "media")
    found = media_columns.document_media(awkward, scratch).collect()
    store = {r.digest: bytes(r.media) for r in spark.read.parquet(f"{scratch.root}/store").collect()}
    assert len(store) == len({r.payload_sha256 for r in found}) == spark.read.parquet(f"{scratch.root}/store").count()
    for r in found:
        media = store[r.payload_sha256]
        assert hashlib.sha256(media).hexdigest() == r.media_sha256 and hashlib.sha256(media_columns.read_png(media)[0]).hexdigest() == r.payload_sha256
    source = texts(awkward)
    for r in media_columns.parse(media_columns.pages_of(awkward.where("doc_id is not null")), "doc_id").collect():
        assert [s.text for s in r.segments if s.kind == "text"] == [t for t in [" ".join((source[r.doc_id] or "").split())] if t]


# Pipeline


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        if i == 2:
            assert {r.doc_id for r in out.collect()} == {c for d, (_, c) in components(texts(docs), 5, 80).items()}
        if i < 4:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_pipeline_drops_what_op8_rejects(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert any(0.3 <= r.score < 0.5 for r in rows)
    kept = [r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in rows if not r.predicted)
