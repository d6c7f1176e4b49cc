"""Operators 3, 4, 6, 7, 8 and 10, and the pipeline."""

import hashlib
import heapq
import html
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from skein.llm import bpe, language, main_text, mixing, queries, toxicity, vector_search


# 3


def test_apportionment_by_highest_quotients():
    rng = random.Random(2)
    for _ in range(300):
        n, seats = rng.randint(1, 9), rng.randint(0, 60)
        w, most = [rng.choice([0, 1, 2, 3, 7, 19]) for _ in range(n)], [rng.randint(0, 30) for _ in range(n)]
        heap = [(-Fraction(x, 1), i) for i, x in enumerate(w) if x and most[i]]
        heapq.heapify(heap)
        want = [0] * n
        for _ in range(seats):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            want[i] += 1
            if want[i] < most[i]:
                heapq.heappush(heap, (-Fraction(w[i], 2 * want[i] + 1), i))
        assert mixing.apportion(np.array(w), seats, np.array(most)).tolist() == want


def test_targets_stop_at_three_passes():
    assert mixing.targets([100, 10, 10, 1], [1, 2, 3, 1]) == [58.0, 30.0, 30.0, 3.0]
    assert mixing.targets([0, 5], [1, 2]) == [0.0, 5.0]
    assert mixing.targets([], []) == []


def test_mix_holds_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "Z", None]), " ".join(["w"] * rng.randint(0, 60)), 1, 2) for i in range(600)]
    rows += [(700, "tiny", "one two three", 1, 2), (701, "none", None, 1, 2), (702, "none", " \n", 1, 2), (None, "b", "x y", 1, 2), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, taken int")
    out = mixing.mix(df, shard_rows=50)
    first = sorted(map(tuple, out.collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(df.repartition(7), shard_rows=50).collect()), key=str)
    assert len(first) == len(rows)
    by = {}
    for doc, source, size, source_size, target, taken, _ in first:
        assert 0 <= taken <= 3 * size
        got = by.setdefault(source, [0, 0, source_size, target])
        got[0] += size
        got[1] += taken
    total = sum(v[0] for v in by.values())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([by[s][0] for s in names], [1 + i % 3 for i in range(len(names))])))
    for s, (size, taken, source_size, target) in by.items():
        assert size == source_size and target == pytest.approx(want[s]) and abs(taken - target) <= 1 + total / 1000
    assert mixing.mix(df.limit(0)).collect() == []


# 4


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    x = np.float32(centres[rng.integers(0, 30, 3000)] + 0.5 * rng.standard_normal((3000, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(4000, None), (4100, [0.0] * 16), (4200, [float("nan")] * 16), (4300, [None] * 16), (4400, [1.0, 2.0]), (4500, [1.0, 2.5]), (None, rows[0][1]), (4600, rows[0][1]), (4601, rows[0][1]), (4600, rows[0][1])]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, leaf int, score double")
    out = vector_search.nearest(df, queries.F.col("vec_id") % 100 == 0, block_rows=100).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {i: np.array(e, float) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    many = [i for i, e in rows if i in good]
    hits = n = 0
    for q in (i for i in good if i % 100 == 0):
        want = sorted((float(np.sqrt(((good[q] - good[c]) ** 2).sum())), c) for c in many if c != q and len(good[c]) == len(good[q]))[:10]
        assert all(s == pytest.approx(float(np.sqrt(((good[q] - good[v]) ** 2).sum())), abs=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        hits += len({c for _, c in want} & {v for v, _ in got[q]})
        n += len({c for _, c in want})
    assert hits / n >= 0.95 and set(got) == {i for i in good if i % 100 == 0}
    assert [v for v, _ in got[4400]] == [4500]
    assert vector_search.nearest(df.limit(0), queries.F.col("vec_id") % 100 == 0).collect() == []


# 6


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just   text\n here", "just text here"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>a</li></ul></nav><div class='ad'>Buy now</div><article><h1>Head &amp; x</h1><p><b>One<br>two<p>Three&nbsp;four</p></article><footer>&copy;</footer>", "Head & x\nOne two\nThree four"),
        ("<body><header>Site</header><main><header><h1>T</h1></header><p>Body</p><aside>side</aside><form><input>Send</form><p>More</p><section id='comments'><p>me too</p></section></main><script>var a='</p>';</script>", "T\nBody\nMore"),
        ("<article><p>a <!-- no --> b</p><div role=alert>x</div><p>1 &lt; 2 > 1</p></article>", "a b\n1 < 2 > 1"),
        ("<nav>unclosed<article>kept</article>", "kept"),
        ("<main><p>teaser</p><article><div class='entry-header'><h1>T</h1></div><p>B</p><div class='share'>s</div><article class='comment'><p>me too</p></article><footer>by</footer><p>C</p></article></main>", "T\nB\nC"),
        ("<body class='has-sidebar'><div id='page' class='no-sidebar wide'><p>" + "long text " * 20 + "</p></div><div class='left-sidebar'>side</div>", ("long text " * 20).strip()),
        ("<p>" + "long text " * 20 + "</p><div class='cookie-notice'>we use</div>", ("long text " * 20).strip()),
    ],
)
def test_main_text(page, want):
    assert main_text.main_text(page) == want


def test_main_text_of_unmarked_pages_keeps_the_surge():
    menu = "".join(f"<div>m{i}</div>" for i in range(8))
    body = "".join(f"<p>{'words of an article ' * 8}{i}</p>" for i in range(6))
    out = main_text.main_text(f"<body>{menu}<nav></nav>{body}<div class=footer>f</div><div>tail</div>")
    assert out.split("\n") == [f"{'words of an article ' * 8}{i}" for i in range(6)]


def test_names_in_an_article_that_hold_marks_are_kept():
    page = "<article><p>A</p><section class='related-work'><p>R</p></section><div class='social-policy'>S</div><div class='related-posts'>x</div><div class='social share-buttons'>y</div></article>"
    assert main_text.main_text(page) == "A\nR\nS"


def test_pages_without_marks():
    text = "A paragraph of some words that is the only text on this page."
    assert main_text.main_text(f"<div>Home</div><div>News</div><div>Sport</div><div>Contact</div><p>{text}</p><div>© 2024 Example Ltd. All rights reserved.</div>") == text
    links = "".join(f"<li><a href='/{k}'>a longer link of five words {k}</a></li>" for k in range(9))
    assert main_text.main_text(f"<ul>{links}</ul><h1>Head</h1><p>{text}</p><p>Yes.</p><h2>Sub</h2><p>{text}</p><ul>{links}</ul>") == f"Head\n{text}\nYes.\nSub\n{text}"
    assert main_text.main_text(f"<article><h1>T</h1><p>{text}</p><ul>{links}</ul></article>").split("\n")[:2] == ["T", text]
    assert "link of five words 5" not in main_text.main_text(f"<article><h1>T</h1><p>{text}</p><ul>{links}</ul></article>")


def brute_main(blocks):
    """Blocks (text, weight): kept if a line of weight stands among it and the two before it."""
    return [t for i, (t, _) in enumerate(blocks) if any(w for _, w in blocks[max(0, i - 2) : i + 1])]


def test_lines_of_an_article_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        blocks = [(f"t{k} {'word ' * rng.randint(0, 8)}".strip(), rng.random() < 0.4) for k in range(rng.randint(1, 14))]
        page = "<article>" + "".join(f"<p>{t}</p>" if w else f"<p><a href=x>{t}</a></p>" for t, w in blocks) + "</article>"
        want = brute_main(blocks) if any(w for _, w in blocks) else [t for t, _ in blocks]
        assert main_text.main_text(page).split("\n") == want


def test_extract_keeps_rows_and_the_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = main_text.extract(pages.withColumn("text", queries.F.lit("clash"))).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in out)
    assert all("©" not in r.text and "track(" not in r.text for r in out)
    edge = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>" + "x" * 100_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in main_text.extract(edge).collect()) == [0, 0, 100_000]
    assert main_text.extract(edge.limit(0)).collect() == []


# 7


def test_disguises_are_restored():
    words = "the idiot loser and scum of this stupid pathetic moron clown is trash worthless disgusting thing in that".split()
    r = toxicity.Restorer(dict(toxicity.trigrams(set(words))))
    for seen, want in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "i d i o t": "idiot", "iiidiooot": "idiot", "l0ser": "loser", "p@thetic": "pathetic", "$cum": "scum", "5tup1d": "stupid", "m0ooor0n": "moron"}.items():
        assert r.restore(seen) == want
    assert {"idiot", "loser"} <= r.features("You 1d10t, l o s e r!") and r.features(None) == set() == r.features(" \n")
    assert "clown" in r.features("clown") and r.restore("") == ""


def test_toxicity_on_held_out_rows(spark):
    out = queries.toxicity_scores(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert sum(r.predicted for r in out if labels.get(r.doc_id) == 0) <= 2


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "a fine text", 1), (2, "you scum", 2), (3, None, 3), (None, "", 4), (2, "you scum", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for own in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        out = toxicity.score(docs, toxicity.fit(docs, own), "doc_id").collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0)), "doc_id").collect() == []


def test_long_and_edged_disguises_are_restored():
    words = "you are the stupid idiot and that clown is such trash loser yours area star".split()
    r = toxicity.Restorer(dict(toxicity.trigrams(set(words))))
    assert {"you", "are", "stupid"} <= r.features(" ".join("youarestupid")) and {"you", "stupid"} <= r.features("y o u a r e s o " + "t h e " * 30 + "s t u p i d")
    assert "stupid" in r.features("st" + "u" * 300 + "pid") and "stupid" in r.features("$tupid") and "loser" in r.features("(1055er lo$er!")
    assert len(r.restore("a1" * 20_000)) <= 40_000


def test_the_character_model_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    one, seven = (sorted(map(tuple, toxicity.count_trigrams(d).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    distinct = {c for r in docs.collect() for w in (r.text or "").lower().split() if len(c := toxicity.clean(w)) > 1 and toxicity.CASED.fullmatch(c)}
    assert one == seven == sorted(toxicity.trigrams(distinct).items())


# 8


def test_copies_take_no_language_away(spark):
    german = [f"der Hund und die Katze gehen nicht in das Haus Nummer {'eins zwei drei vier fünf'.split()[k]}" for k in range(5)]
    english = [f"the dog and the cat do not go into the house of {' '.join(random.Random(k).sample('one two three four five six'.split(), 3))}" for k in range(300)]
    docs = spark.createDataFrame([(t, "de") for t in german * 4_000] + [(t, "en") for t in english], "text string, lang string")
    got = [language.fit(docs.repartition(k)) for k in (1, 7)]
    assert got[0] == got[1] and set(got[0]) == {"de", "en"} and all(w.encode() in got[0]["de"] for w in "eins zwei drei vier fünf".split())
    asked = spark.createDataFrame([(1, "die Katze und der Hund", "x"), (2, "the cat and the dog", "x"), (3, "\u0301\u0301", "x")], "doc_id long, text string, lang_pred string")
    assert {r.doc_id: r.lang_pred for r in language.predict(asked, got[0], "doc_id").collect()} == {1: "de", 2: "en", 3: "und"}


def test_a_dictionary_holds_a_share_of_every_text():
    texts = [f"{chr(97 + k)}{chr(97 + k)} " * (10 if k < 3 else 60_000) for k in range(8)]
    content = language.dictionary(texts)
    assert len(content) <= language.DICTIONARY_BYTES and all(content.count(f"{chr(97 + k)}{chr(97 + k)}".encode()) >= (10 if k < 3 else 8_000) for k in range(8))


def test_whole_long_texts_are_sampled_and_compressed(spark):
    long = "the words of a long text " * 20_000
    docs = spark.createDataFrame([(long + "zebra quagga okapi", "en"), ("un texte court", "fr")], "text string, lang string")
    content = language.fit(docs)
    assert b"okapi" in content["en"] and len(content["en"]) <= 2 * language.PIECE
    assert language.Classifier(content)(long)[0] == "en"


def test_language_on_held_out_rows(spark):
    out = queries.language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) >= 0.97
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == true[r.doc_id] for r in sure) / len(sure) >= 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_cases(spark):
    content = {"aa": language.dictionary(["the cat sat on the mat " * 5]), "bb": language.dictionary(["le chat est sur la table " * 5])}
    docs = spark.createDataFrame([(1, "The cat sat", "x"), (2, None, "x"), (3, "12 34 !", "x"), (4, "", "x"), (5, "LE CHAT EST", "x"), (5, "LE CHAT EST", "x")], "doc_id long, text string, lang_pred string")
    out = [(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(docs, content, "doc_id").orderBy("doc_id").collect()]
    assert out == [(1, "aa", True), (2, "und", False), (3, "und", False), (4, "und", False), (5, "bb", True), (5, "bb", True)]
    assert {r.lang_pred for r in language.predict(docs, {}, "doc_id").collect()} == {"und"}
    assert language.fit(docs.withColumn("lang", queries.F.lit(None).cast("string"))) == {}
    assert language.predict(docs.limit(0), content, "doc_id").collect() == []


# 10


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_encodings_are_the_librarys(tokenizer):
    v = bpe.Vocabulary(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz     0123456789.,;:!?'\"\n\téèßñçあ🙂ー   ABCD<|>"
    texts = ["", " ", "<|endoftext|>a<|endoftext|>  b", "a" * 3000, "===" * 100, "it's they'll WE'VE", "  x\r\n\n y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    pieces = [b.decode("utf-8", "ignore") for b in v.ids]
    texts += ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(800)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = v.encode(texts)
    assert got.to_pylist() == want
    assert v.decode(got) == v.decode(got.slice(0, 5)) + v.decode(got.slice(5)) == [tokenizer.decode(i, skip_special_tokens=False) for i in want] == texts


def test_bpe_query(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.bpe_round_trip(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    edge = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "x " * 50_000, 5), (2, "x " * 50_000, 5)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(edge, queries.tokenizer_path()), queries.tokenizer_path()).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 100_000, 100_000]
    assert bpe.encode(edge.limit(0), queries.tokenizer_path()).collect() == []


# pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == p.COLUMNS
        kept[name] = docs.collect()
    clean = {r.doc_id for r in kept["toxicity"]}
    assert {i for i, y in labels.items() if not y} - clean == set()
    assert len(kept["line dedup"]) == len(kept["toxicity"]) and sum(len(r.text) for r in kept["line dedup"]) < sum(len(r.text) for r in kept["toxicity"])
    ids = [r.doc_id for r in kept["SimHash near-dedup"]]
    assert len(ids) == len(set(ids)) <= len(clean)
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(kept["mixing"]) - size(kept["SimHash near-dedup"])) <= 0.01 * size(kept["mixing"]) + 50
    assert {r.doc_id for r in kept["mixing"]} <= set(ids)
    out = p.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() == len(kept["mixing"])


def test_pipeline_on_no_rows_and_nulls(spark, sf):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "x", "en", None, 1), (2, "x", "en", None, 1), (3, html.unescape("caf&eacute;\n") * 40, "fr", "b", 200)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
