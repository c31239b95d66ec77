import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, chat_format, decontamination, html_text, language_id, license_scan, made_up_pages, near_duplicates, oracle, queries, top_k, toxicity, url_filter
from quarry.llm.common import held_out

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
#: Null, empty, blank and letterless texts, a long one, repeated rows, a null id.
TEXTS = [
    (1, None, "en"), (2, "", "en"), (3, "  \n", None), (4, "123 --", "en"), (5, "the cat and the dog of the house", "en"), (5, "the cat and the dog of the house", "en"),
    (6, "der hund und die katze in dem haus", "de"), (7, "x " * 30_000, None), (None, "the end of the house", "en"), (8, "der hund und die katze in dem haus", "de"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, "clash") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), con.sql(oracle.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(str, ours[columns].values.tolist())) == sorted(map(str, theirs[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, name):
    same_as_sql(spark, name)


# language identification


def test_language_held_out(spark, sf):
    model = language_id.train(sf, where=~held_out())
    found = language_id.predict(sf, model).join(sf.select("doc_id", "lang"), "doc_id").where(held_out())
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_language_odd_rows(odd, none):
    model = language_id.train(odd)
    found = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect()]
    assert len(found) == len(TEXTS)
    assert {i for i, lang in found if lang == "und"} == {1, 2, 3, 4}
    assert (6, "de") in found and (5, "en") in found
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert kept.where("doc_id < 5").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_unseen_words_back_off():
    model = language_id.Model([("a", "running", 5), ("a", "walking", 5), ("b", "laufen", 5), ("b", "gehen", 5)])
    assert [lang for lang, _ in model.scores(["jumping", "kaufen"])] == ["a", "b"]


def language_by_hand(rows, texts, orders=5):
    """Scores by dictionaries and loops: words, then the longest order of n-grams with a known gram."""
    langs = sorted({lang for lang, _, _ in rows})
    tables = [{} for _ in range(orders + 1)]
    for lang, word, n in rows:
        at, framed = langs.index(lang), f"^{word}$"
        tables[0].setdefault(word, [0.0] * len(langs))[at] += n
        for k in range(1, orders + 1):
            for i in range(len(framed) - k + 1):
                tables[k].setdefault(framed[i : i + k], [0.0] * len(langs))[at] += 1 + np.log(n)
    totals = [np.sum(list(t.values()), axis=0) + 0.5 * len(t) for t in tables]
    score = lambda k, key: np.log((np.array(tables[k][key]) + 0.5) / totals[k])

    def of_word(word):
        if word in tables[0]:
            return score(0, word)
        framed = f"^{word}$"
        for k in range(orders, 0, -1):
            if known := [framed[i : i + k] for i in range(len(framed) - k + 1) if framed[i : i + k] in tables[k]]:
                return np.mean([score(k, g) for g in known], axis=0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        words = ["".join(g) for g in re.findall("((?:[^\\W\\d_])+)", (text or "").lower())]
        if not words:
            out.append(("und", 0.0))
            continue
        total = np.mean([of_word(w) for w in words], axis=0) * min(len(words), 30)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        out.append((langs[int(share.argmax())], share.max()))
    return out


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_language_by_hand(monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 7)))
    rows = [(lang, word(letters), rng.randint(1, 40)) for lang, letters in (("x", "abcde"), ("y", "defgé"), ("zz", "日本eg")) for _ in range(60)]
    texts = [" ".join(rng.choice(rows)[1] if rng.random() < 0.5 else word("abcdefgé日qw") for _ in range(rng.randint(0, 50))) for _ in range(60)] + [None, "", "12 !", "QWW"]
    found, wanted = language_id.Model(rows).scores(texts), language_by_hand(rows, texts)
    assert [x for x, _ in found] == [x for x, _ in wanted]
    assert np.allclose([x for _, x in found], [x for _, x in wanted], atol=1e-4)
    tied = language_id.Model([("b", "same", 3), ("a", "same", 3), ("c", "same", 3)]).scores(["same", "other"])
    assert [lang for lang, _ in tied] == ["a", "a"]


def test_many_languages_one_of_them_rare(spark):
    """600 languages; that with two rows is learnt like the others."""
    rng = random.Random(6)
    letters = "bcdfghjklmnpqrstvwxz"
    known = ["".join([letters[i // 20 % 20], letters[i % 20], v, letters[i // 400]]) for i in range(600) for v in "aeiou"]
    made = lambda i: rng.choices(known[5 * i : 5 * i + 5], k=12)
    rows = [(1000 * i + k, " ".join(made(i)), f"l{i:03}") for i in range(600) for k in range(2 if i == 77 else 6)]
    docs = docs_of(spark, rows)
    model = language_id.train(docs, max_rows=3000)
    assert len(model.languages) == 600
    texts = [" ".join(made(i)) for i in range(600)]
    found = [lang for lang, _ in model.scores(texts)]
    assert found[77] == "l077" and np.mean([f == f"l{i:03}" for i, f in enumerate(found)]) > 0.95


# toxicity


def made_up_toxicity(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("bcdlmnrst", k=2)) + rng.choice("aeiou") + "".join(rng.choices("aeioulmn", k=3)) for _ in range(300)]
    bad = ["idiotic", "moronic", "scumbag"]
    texts, labels = [], []
    for i in range(n):
        text = rng.choices(clean, k=rng.randint(5, 200))
        if i % 2:
            text[rng.randrange(len(text))] = rng.choice(bad)
        texts.append(" ".join(text))
        labels.append(i % 2)
    return texts, labels


def test_toxicity_finds_misspellings_and_spares_clean_texts():
    model = toxicity.fit(*made_up_toxicity(400, 1))
    texts, labels = made_up_toxicity(100, 1)
    texts = [t.replace("idiotic", "idiiotic").replace("moronic", "moronicc") for t in texts]
    right = (model.scores(texts) >= 0.5) == (np.array(labels) == 1)
    assert right.mean() >= 0.95


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 0), (2, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, labels)
    scores = toxicity.predict(odd, model).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scores)
    one_class = toxicity.train(odd, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.predict(odd, one_class).collect()} == {0.0}
    assert toxicity.keep_civil(odd, one_class).count() == len(TEXTS)
    assert toxicity.keep_civil(odd, toxicity.train(odd, labels.selectExpr("doc_id", "1 AS toxic"))).count() == len(TEXTS)
    assert toxicity.predict(none, toxicity.train(none, labels)).count() == 0


INSULTS = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}


def test_toxicity_held_out(spark, sf="sf0.1"):
    """Recall and precision of label 1 on rows that were not learnt from.

    Some texts labelled 1 hold no telling word of their language, so not all can be found;
    those with an English insult must be, and nearly all others.
    """
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    found = queries.op9_toxicity(spark, f"/root/testdata/{sf}").join(read("labels"), "doc_id").join(read("documents").select("doc_id", "text"), "doc_id")
    rows = found.where("held_out").select("toxic", "predicted", "text").collect()
    toxic = [r for r in rows if r["toxic"]]
    insults = [r for r in toxic if INSULTS & set(re.findall("[a-z]+", r["text"].lower()))]
    called = [r for r in rows if r["predicted"]]
    assert len(toxic) > 90 and sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert len(insults) > 40 and all(r["predicted"] for r in insults)
    assert sum(r["toxic"] for r in called) >= 0.9 * len(called)


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    """Labels without a document take no places of the sample."""
    texts, toxic = made_up_toxicity(200, 3)
    docs = docs_of(spark, [(100 * i, t, None) for i, t in enumerate(texts)])
    named = {100 * i: y for i, y in enumerate(toxic)}
    labels = spark.createDataFrame([(i, named.get(i, i % 2)) for i in range(20_000)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, **more: seen.append(sorted(texts)) or fit(texts, labels, **more))
    toxicity.train(docs, labels, rows_per_class=150)
    toxicity.train(docs, labels, rows_per_class=30)
    toxicity.train(docs, labels, chars_per_class=3000)
    assert seen[0] == sorted(texts) and len(seen[1]) == 60 and sum(map(len, seen[2])) <= 6000 and len(seen[2]) > 2


def test_words_of_a_span_add_once():
    """Against a plain loop over all spans."""
    rng = random.Random(4)
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.25)
    texts = [" ".join(rng.choices(["aa", "bb", "Idiot", "ça", "c", "the same"], k=rng.randint(0, 40))) for _ in range(40)] + [None, "", " . ", "x" * 5000]

    def slow(text):
        w = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
        one = {x: toxicity._grams(np.frombuffer(b" " + x + b" ", np.uint8))[0] for x in w}
        spans = [w[i : i + 12] for i in range(max(1, len(w) - 11))] if w else []
        return 0.25 + max((sum(model.weights[one[x]].sum() for x in set(s)) / max(1, sum(len(one[x]) for x in s)) for s in spans), default=0.0)

    assert np.allclose(model.peaks(texts), [slow(t) for t in texts])


# decontamination


def by_hand(text, items, length=10):
    doc, hit, ids = words(text), set(), set()
    for item, passage in items:
        row = words(passage)
        n = min(length, len(row))
        for i in range(len(row) - n + 1 if row else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == row[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return len(doc), len(hit), sorted(ids)


@pytest.mark.parametrize("block_chars", [8_000_000, 60])
def test_decontamination_by_hand(spark, block_chars):
    rng = random.Random(4)
    vocabulary = ["a", "b", "C", "dé", "e1"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 15]))) for i in range(12)] + [(3, text(12)), (99, None), (98, " .")]
    texts = [text(60) + " , " + items[i % 12][1].upper() for i in range(15)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None), (77, None, None)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items] + [(None, "a b", 1)], "item_id long, text string, n_hit int")
    found = decontamination.match(docs_of(spark, rows), table, block_chars=block_chars).collect()
    assert len(found) == len(rows)
    wanted = {i: by_hand(t, [x for x in items if x[1]]) for i, t, _ in rows}
    for r in found:
        assert (r["n_words"], r["n_hit"], sorted({m["item_id"] for m in r["exact"]})) == wanted[r["doc_id"]]


def test_proximity_and_filter(spark, none):
    items = spark.createDataFrame([(1, "zebra quagga okapi gnu eland kudu oryx nyala topi bongo")], "item_id long, text string")
    rows = docs_of(spark, [(1, "bongo kudu eland gnu zebra oryx topi nyala okapi quagga", None), (2, "so zebra quagga okapi gnu eland kudu oryx nyala topi bongo", None), (3, "clean", None)])
    found = {r["doc_id"]: r for r in decontamination.match(rows, items).collect()}
    assert found[1]["near"] == ["1"] and not found[1]["exact"]
    assert found[2]["n_hit"] == 10 and not found[2]["near"]
    kept = decontamination.drop_contaminated(rows, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == rows.columns
    assert decontamination.match(rows, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.match(none, items).count() == 0


def near_by_hand(texts, items, length, slop):
    """Items of each text with a window whose three rarest terms stand near the rarest one, but not one exact window."""
    docs = [words(t) for t in texts]
    windows = {}
    for item, passage in items:
        row = words(passage)
        n = min(length, len(row))
        for i in range(len(row) - n + 1 if row else 0):
            windows.setdefault(tuple(row[i : i + n]), set()).add(str(item))
    out = []
    for doc in docs:
        exact, near = set(), set()
        for window, owners in windows.items():
            if any(tuple(doc[j : j + len(window)]) == window for j in range(len(doc))):
                exact |= owners
                continue
            order = sorted(range(len(window)), key=lambda i: (sum(window[i] in d for d in docs), i))
            rare = list(dict.fromkeys(window[i] for i in order))[:3]
            places = [[j for j, w in enumerate(doc) if w == t] for t in rare]
            if len(rare) > 1 and any(all(any(abs(i - j) <= slop for j in here) for here in places[1:]) for i in places[0]):
                near |= owners
        out.append(sorted(near - exact))
    return out


@pytest.mark.parametrize("segment_bytes", [1, 150, 2_000_000])
def test_index_serves_many_benchmarks(spark, segment_bytes):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 31), k=rng.randint(0, 60))) for _ in range(40)] + [None, "w1 " * 500]
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    segments = decontamination.index(docs, segment_bytes).cache()
    for seed in (1, 2):
        rng = random.Random(seed)
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(30)] + [(90, texts[3]), (91, "unknown words")]
        table = spark.createDataFrame(items, "item_id long, text string")
        found = {r["doc_id"]: r for r in decontamination.match_index(segments, table, length=4, slop=3).collect()}
        near = near_by_hand([t or "" for t in texts], items, 4, 3)
        for i, t in enumerate(texts):
            assert (found[i]["n_words"], found[i]["n_hit"], sorted({m["item_id"] for m in found[i]["exact"]})) == by_hand(t, items, 4)
            assert found[i]["near"] == near[i]


# tokens

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PIECES = st.lists(
    st.one_of(
        st.sampled_from(["The ", "eau", "'s ", "\n\n", "<|endoftext|>", "<|", "12", "İ", "ΣΑΣ ", "ﬁ", "e\u0301 ", "日本語", "\u00a0", "\x00", "\x1c", "!!! ", "ǅ", "naïve ", "  "]),
        st.text(max_size=12),
    ),
    max_size=300,
).map("".join)


@settings(max_examples=60, deadline=None)
@given(PIECES)
def test_tokens_are_the_librarys(text):
    coder = _coder()
    text = text.encode("utf-8", "ignore").decode()
    wanted = coder.encode.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder(text.encode()), coder.encode.kind).tolist() == wanted
    assert coder.encode.decode(wanted) == coder.encode.library.decode(wanted, skip_special_tokens=False)


_CODERS = []


def _coder():
    if not _CODERS:
        _CODERS.append(bpe.Coder(bpe.Encoder(PATH)))
    return _CODERS[0]


class Leaning:
    """An encoder in which a word that begins with z depends on all z-words right before it, and on the word before those."""

    def __call__(self, text):
        words, ids = text.split(), []
        for i, w in enumerate(words):
            k = i
            while words[k].startswith("z") and k:
                k -= 1
            ids.append(int.from_bytes(hashlib.sha256(" ".join(words[k : i + 1]).encode()).digest()[:2]))
        return np.array(ids, np.uint16).tobytes()

    whole = __call__


@pytest.mark.parametrize("run", [0, 3, 12, 60])
def test_joins_widen_until_they_agree(run):
    rng = random.Random(run)
    coder = bpe.Coder(Leaning())
    for _ in range(30):
        text = " ".join(rng.choices("abc", k=1)[0] * rng.randint(1, 6) if rng.random() > run / (run + 1) else "z" + rng.choice("pqr") * 3 for _ in range(900))
        assert coder(text.encode()) == Leaning()(text)
    assert (coder.widened > 0) == (run > 0) and (run > 3 or not coder.given_up)


def test_words_at_the_ends_of_a_text():
    text = "  aa bb\n cc"
    assert [text[: bpe.first_words(text, n)] for n in (0, 1, 2, 3, 9)] == ["", "  aa", "  aa bb", text, text]
    assert [text[bpe.last_words(text, n) :] for n in (0, 1, 2, 3, 9)] == ["", "\n cc", " bb\n cc", text, text]


def test_chunks_follow_the_content():
    rng = random.Random(1)
    shared = "".join(rng.choices("abcdefgh ", k=20_000))
    one, two = (bpe.chunks(("x" * n + " " + shared).encode()) for n in (10, 777))
    assert len(set(one) & set(two)) > 0.8 * len(one)
    assert b"".join(one) == ("x" * 10 + " " + shared).encode()
    text = ("é" * 5000 + "日本" * 3000).encode()
    assert all(c.decode() for c in bpe.chunks(text))


def test_tokens_of_tables(spark, library, sf, odd, none):
    for table in (sf, odd):
        texts = table.select("doc_id", "text").collect()
        wanted = sorted(
            (str(r["doc_id"]), len(ids := library.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in texts
        )
        assert sorted((str(r[0]), *r[1:]) for r in bpe.encode(table, PATH).collect()) == wanted
    assert bpe.encode(none, PATH).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH, with_ids=True), PATH).where("doc_id = 6").first()["text"]
    assert back.replace(" ", "").replace("</w>", " ").split() == TEXTS[6][1].split()


# web pages


def test_made_up_pages_that_were_not_trained_on():
    trees, right = html_text.model(), []
    for source in made_up_pages.pages(120, 77):
        page = html_text.Page(source)
        wanted = " ".join(t for node, t, _ in page.runs if t and page.marks[node])
        got = page.text(page.decode(trees.margin(page.features())))
        a, b = set(wanted.split()), set(got.split())
        right.append(len(a & b) / max(1, len(a | b)) if a or b else 1.0)
    assert np.mean(right) > 0.95
    assert np.mean(np.array(right) == 1) > 0.9


def test_labels_never_contradict():
    trees = html_text.model()
    for source in made_up_pages.pages(30, 5):
        page = html_text.Page(source)
        kept = page.decode(trees.margin(page.features()))
        assert all(not kept[i] or kept[page.parents[i]] for i in range(1, len(kept)))


def test_article_of_a_page(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>home</a></li></ul></nav><div class=ad>buy now</div>"
        "<article><h1>A &amp; B</h1><p>One&nbsp;two\n three, and more of it.<br>four<p>Five <b>six</b>seven, which ends the text.</article><footer>&copy; me</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<<a <p"), (5, "u", "<script>" + "x" * 100_000)], "page_id long, url string, html string")
    found = [tuple(r) for r in html_text.extract(rows).collect()]
    text = "A & B One two three, and more of it. four Five sixseven, which ends the text."
    assert found.count((1, "u", text, len(text))) == 2
    assert (2, None, "", 0) in found and (3, "u", "", 0) in found and (5, "u", "", 0) in found and len(found) == 6
    assert html_text.extract(rows.limit(0)).count() == 0


TEXT = "<h1>A title</h1><p>First paragraph of the text, which is long enough to be one.</p><p>Second paragraph, which follows, and is as long as the first was.</p>"
PLAIN = "A title First paragraph of the text, which is long enough to be one. Second paragraph, which follows, and is as long as the first was."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><article class='comment-policy review'>{TEXT}<p>A third one.</p></article><footer>&copy; us</footer>",
        f"<div class=kopfzeile>Die Zeitung</div><div class=inhalt>{TEXT}</div><div class=kommentare><div>Hans: Das ist ja schön, ich war auch da.</div></div><div class=fusszeile>Alle Rechte vorbehalten</div>",
        f"<article>{TEXT}</article><div>Copyright 2020 Some Company. All rights reserved.</div>",
        f"<table><tr><td><a href=/>Home</a> <a href=/news>News</a></td><td>{TEXT}</td></tr></table>",
        f"<table><tr><td>Home<br>News</td><td>{TEXT}</td></tr></table>",
        f"<div class=entete>Le Journal</div><div class=contenu>{TEXT}</div><div class=commentaires><p>Jean: je suis de cet avis.</p></div><div class=pied-de-page>Droits réservés</div>",
    ],
)
def test_pages_that_name_things_otherwise(page):
    wanted = PLAIN + " A third one." * ("third" in page)
    assert html_text.main_texts([f"<html><body>{page}</body></html>"], html_text.model()) == [wanted]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_pages_of_the_table_give_their_article(spark, sf):
    """The article element of each page, read by a plain pattern: its text between tags."""
    import html

    table = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    inline = r"</?(?:a|b|em|i|span|strong|code)\b[^>]*>"
    articles = 0
    for r in table.collect():
        inside = re.findall(r"<article[^>]*>(.*?)</article>", r["html"], re.S)
        if len(inside) == 1 and not re.search(r"<(?!/?(?:p|h\d|b|br|a|em|i|span|strong|code|ul|ol|li|pre|blockquote)\b)", inside[0]):
            articles += 1
            blocks = re.sub(r"<[^>]*>", "\n", re.sub(inline, "", inside[0]))
            assert found[r["page_id"]] == " ".join(html.unescape(blocks).split()), r["page_id"]
    assert articles > 0.9 * len(found)


def test_pages_with_columns_of_the_result(spark):
    table = spark.createDataFrame([(1, "u", f"<article>{TEXT}</article>", "own", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract(table).collect()] == [(1, "u", PLAIN, len(PLAIN))]


@pytest.mark.parametrize("tag", ["script", "STYLE", "noscript"])
def test_closing_tags_after_letters_that_grow(tag):
    page = html_text.Page(f"<p>{'İ' * 30}</p><{tag}>var a = '</p>'</{tag}><p>Bu bir metin.</p><{tag}>b</{tag.swapcase()}><footer>son</footer>")
    assert [(page.tags[node], text) for node, text, _ in page.runs] == [("p", "İ" * 30), ("p", "Bu bir metin."), ("footer", "son")]


def test_only_text_that_no_browser_shows_is_cut_away():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    page = html_text.Page(
        f"<p>Let {formula} be.</p><svg><path d='M0'/><text>axis</text></svg><object>shown</object><map>plan</map><button>press</button>"
        "<select><option>one<option>two</select><video>old</video><canvas>old</canvas><p>End.</p>"
    )
    assert [text for _, text, _ in page.runs] == ["Let x=1 be.", "axis", "shown", "plan", "press", "one", "two", "End."]
    assert len({page.depths[i] for i, tag in enumerate(page.tags) if tag == "p"}) == 1
    article = f"<nav><a href=/>home</a></nav><article><h1>Title of it</h1><p>Let the value {formula} be given, as in all that follows here.</p><p>And more, of it.</p></article>"
    assert html_text.main_texts([article], html_text.model()) == ["Title of it Let the value x=1 be given, as in all that follows here. And more, of it."]


@pytest.mark.parametrize("n", [10, 49, 80])
def test_share_of_equal_siblings_at_every_size(n):
    page = html_text.Page("<p>text</p>" * (n - 1) + "<nav>menu</nav>")
    shares = page.features()[:, 16]
    assert shares[page.tags.index("nav")] == 1 / n and shares[page.tags.index("p")] == (n - 1) / n


# top k


def brute_top(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q, vectors in whole.items():
        if q % every:
            continue
        best = {}
        for v in vectors:
            for c, others in whole.items():
                for o in others:
                    if c != q and len(o) == len(v):
                        s = sum(a * b for a, b in zip(v, o, strict=True))
                        best[c] = max(best.get(c, s), s)
        best = {c: min(max(s, -(2**63)), 2**63 - 1) for c, s in best.items()}
        out += [(q, rank, c, s) for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6, 1e15])
def test_top_k_by_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(top_k, "DATA_BYTES", 600)
    monkeypatch.setattr(top_k, "QUERY_BYTES", 100)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (rng.normal(size=4) * scale if i % 3 else np.ones(4))]) for i in range(150)]
    rows += [(0, rows[0][1]), (7, [5.0] * 4), (None, [1.0] * 4), (200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [1.0] * 3), (210, [2.0] * 3), (10, [])]
    if scale > 1:
        rows = rows[:150]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = sorted(tuple(r) for r in top_k.search(table, k=5, every=10).collect())
    assert found == brute_top(rows, 5, 10)
    assert top_k.search(table.limit(0)).count() == 0


def test_summaries_rule_out_far_groups():
    pivots = np.array([[10.0, 0.0], [-10.0, 0.0]])
    assert top_k.open_groups(pivots, {0: (50, 1.0), 1: (50, 1.0)}, {0: 0.5}, 5) == {0: [0]}


def test_top_k_rules_out_groups_that_are_far(spark, monkeypatch):
    monkeypatch.setattr(top_k, "DATA_BYTES", 2000)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 40
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top_k.pruned(table, every=10) > 0.5
    assert sorted(tuple(r) for r in top_k.search(table, k=5, every=10).collect()) == brute_top(rows, 5, 10)


def test_top_k_of_many_lengths(spark, monkeypatch):
    """More lengths than the sample shows: those without pivots are searched whole."""
    monkeypatch.setattr(top_k, "SAMPLE", 20)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=i % 60)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k.search(table, k=5, every=10).collect()) == brute_top(rows, 5, 10)


def test_top_k_where_every_row_is_repeated(spark):
    rng = np.random.default_rng(3)
    places = [(3 * c + i, [10.0 * (c + 1) + float(rng.normal()) * 0.01, float(rng.normal()) * 0.01]) for c in range(8) for i in range(3)]
    rows = [row for row in places for _ in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k.search(table, k=5, every=1).collect()) == brute_top(places, 5, 1)


# urls


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/7?x", "x://b.com/en/1", "x://com/en/1#f", "x://acom/en/1", "x://t.example.net/de/812", "x://net/de/8", "ftp://h?q=a://b", "x://h/" + "a/" * 5000]
    rows = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(rows).collect()}
    assert found[0] == found[1] == ("", "", None, "allow")
    assert found[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[3] == ("b.com", "/en/1", "com/en/", "block") and found[4][2] == "com/en/"
    assert found[5][2] is None
    assert found[6][2:] == ("example.net/de/8", "block") and found[7][2:] == ("net/de/", "allow")
    assert found[8][:2] == ("h", "")
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_templates_spread_labels(spark):
    urls = [(i, f"x://h.org/buy/item-{i}") for i in range(40)] + [(100 + i, f"x://h.org/news/{i}/a") for i in range(10)]
    rows = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, "block") for i in range(10)] + [(100, "allow")], "page_id long, label string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, labels=labels).collect()}
    assert {found[i] for i in range(40)} == {"block"} and {found[100 + i] for i in range(10)} == {"allow"}


WORDS_OF_URLS = [a + b for a in "abcde" for b in "vwxyz"]


@pytest.mark.parametrize("above", ["a/b/c", "a/" * 2000 + "b"])
def test_templates_reach_the_real_depth(spark, above):
    urls = [(i + at, f"x://h.org/{above}/{kind}/{w}") for at, kind in ((0, "ads"), (100, "news")) for i, w in enumerate(WORDS_OF_URLS)]
    rows = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i + at, label) for at, label in ((0, "block"), (100, "allow")) for i in range(20)], "page_id long, label string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, labels=labels).collect()}
    assert {found[i] for i in range(25)} == {"block"} and {found[100 + i] for i in range(25)} == {"allow"}


def test_branches_merge_at_every_level(spark):
    urls = [(10 * b + i, f"x://h.org/en/{name}/{i}") for b, name in enumerate(("ab", "cd", "ef", "gh")) for i in range(6)]
    urls += [(100 + i, f"x://i.org/en/good/{i}") for i in range(40)]
    rows = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(10 * b + i, "block") for b in range(4) for i in range(3)] + [(100 + i, "allow") for i in range(40)], "page_id long, label string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, labels=labels).collect()}
    assert {v for i, v in found.items() if i < 100} == {"block"} and {v for i, v in found.items() if i >= 100} == {"allow"}


def test_labels_reach_siblings_built_alike_alone(spark):
    urls = [(i, f"x://h.org/en/{i}") for i in range(30)] + [(100 + i, f"x://h.org/fr/{i}.html") for i in range(10)]
    urls += [(200 + i, f"x://h.org/de/{i}") for i in range(10)] + [(300 + i, f"x://h.org/api/{i}/raw") for i in range(10)]
    urls += [(400 + i, f"x://i.org/de/{i}") for i in range(40)] + [(500, "x://i.org/en/1"), (501, "x://i.org/en/2"), (502, "x://i.org/en/3")]
    rows = spark.createDataFrame(urls + urls[:3], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block") for i in range(30)] + [(i, "block") for i in (500, 501, 502)], "page_id long, label string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, labels=labels).collect()}
    assert {found[200 + i] for i in range(10)} == {"block"}  # /de/# goes with /en/#
    assert {found[100 + i] for i in range(10)} == {found[300 + i] for i in range(10)} == {"allow"}  # other endings do not
    assert {found[400 + i] for i in range(40)} == {"allow"}  # three labels say little of 40 urls


# chats


def test_chat_windows_read_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(6):
        if conv % 2:
            rows.append((conv, 0, "system", "be [INST] kind </s>"))
        for turn in range(1, 3 + conv * 12):
            rows.append((conv, turn, "assistant" if turn % 2 == 0 else "user", " ".join(rng.choices(["w", r"<\|x", "[/INST]", "[", "\\", "<|user|>", "<s>", "\n"], k=rng.randint(0, 90)))))
    rows += [(9, 1, None, None), (9, 1, None, None), (None, None, "a|>b%", "t"), (10, 1, "assistant", "long " * 20_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    made = chat_format.windows(table).cache()
    found = {r["conv_id"]: r for r in chat_format.digests(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.where("conv_id = 5").count() > 3
    assert made.where("conv_id = 5 and not startswith(formatted, '<s><|system|>')").count() == 0
    assert all(r["n_repeated"] <= 3 for r in made.where("conv_id < 9").select("n_repeated").collect())
    assert chat_format.digests(chat_format.windows(table.limit(0))).count() == 0


def tokens_of(text):
    """Letters or digits in a row, other signs one by one, and a turn's markers."""
    return len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", text)) + 4


def test_chat_windows_keep_the_budget(spark):
    """With every length of system turn: 512 tokens, unless one turn and the system turn alone have more."""
    rng = random.Random(5)
    rows = []
    for conv, system in enumerate((0, 5, 200, 252, 253, 320, 400, 500, 507, 508, 600)):
        if system:
            rows.append((conv, 1 if conv % 3 == 2 else -1, "system", "s " * system))
        for turn in range(60):
            long = rng.random() < 0.1
            rows.append((conv, turn, "user" if turn % 2 else "assistant", "w " * (rng.randint(300, 700) if long else rng.randint(0, 130))))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(table).cache()
    whole = chat_format.read_back(made.withColumn("n_repeated", F.lit(0))).select("conv_id", "window", "turns").join(made, ["conv_id", "window"]).collect()
    several = alone = history = 0
    for r in whole:
        turns = [(t["role"], tokens_of(t["text"])) for t in r["turns"]]
        size, own = sum(n for _, n in turns), turns[r["n_repeated"] :]
        systems = sum(n for role, n in turns if role == "system")
        history += r["n_repeated"] > (turns[0][0] == "system" and r["n_repeated"] > 0)
        if size > 512:
            rest = [n for role, n in own if role != "system"]
            assert len(rest) <= 1 and sum(rest) + systems == size  # nothing more could be given up
            alone += 1
        several += len(own) > 1
    assert several > 50 and alone > 10 and history > 50
    found = {r["conv_id"]: r["n_turns"] for r in chat_format.digests(made).collect()}
    assert found == {conv: sum(r[0] == conv for r in rows) for conv in found}


# licences


def test_license_base_by_hand(spark, sf, odd):
    rows = docs_of(spark, [(1, "MIT license mit LICENSE cc-by; CC by", None), (2, "the gnu general public, license", None), (3, "gnu general public", None), (4, "cc cc by by", None)])
    for table in (rows, sf, odd):
        texts = sorted((str(r["doc_id"]), r["text"]) for r in table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        found = sorted((str(r["doc_id"]), r["n_words"], r["base_places"], r["base_labels"]) for r in license_scan.scan(table).collect())
        wanted = []
        for i, text in texts:
            w = words(text)
            places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
            wanted.append((i, len(w), sorted(p for p, _ in places), sorted({label for _, label in places})))
        assert found == sorted(wanted)


def test_license_passages(spark, none):
    _, mit, _ = license_scan.TEMPLATES[0]
    broken = mit.replace("free of charge", "for a fee")
    rows = docs_of(spark, [(1, "intro " + mit.title() + " outro", None), (2, broken, None), (3, " ".join(reversed(mit.split())), None)])
    found = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    assert found[1]["labels"] == ["mit"] and found[1]["score"] == 1.0 and not found[1]["base_labels"]
    assert found[2]["labels"] == found[3]["labels"] == []
    assert license_scan.scan(none).count() == 0


def in_order(words, template):
    """Length of the longest common subsequence, by table."""
    row = [0] * (len(template) + 1)
    for w in words:
        new = [0]
        for j, t in enumerate(template):
            new.append(row[j] + 1 if w == t else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def license_by_hand(text):
    """Labels and score without index, votes or frequencies: every mandatory phrase at every word."""
    w = words(text)
    labels = {label for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()}
    score = 1.0 if labels else 0.0

    def holds(part, phrase, put_in):
        wanted = iter(part[: len(phrase) + put_in])
        return part[:1] == phrase[:1] and all(any(x == p for x in wanted) for p in phrase)

    for label, template, keys in license_scan.TEMPLATES:
        put_in, template = 2 if keys else 0, template.split()
        keys = [k.split() for k in keys] or [template]
        before = " ".join(template).split(" ".join(keys[0]))[0].count(" ")
        after = len(template) - before
        for at in range(len(w)):
            if not holds(w[at:], keys[0], put_in):
                continue
            here = w[max(0, at - before - before // 2) : at + after + after // 2 + 2]
            share = in_order(here, template) / len(template)
            if share >= 0.5 and all(any(holds(here[i:], k, put_in) for i in range(len(here))) for k in keys):
                labels.add(label)
                score = max(score, share)
    return sorted(labels), score


def test_license_labels_by_hand(spark, sf, odd, none):
    rng = random.Random(8)
    common = "the of and to in for a this is software license any under".split()
    texts = []
    for label, template, _ in license_scan.TEMPLATES:
        t = template.split()
        texts.append(" ".join(rng.choices(common, k=40) + t + rng.choices(common, k=30)).title())
        texts.append(" ".join(x for i, w in enumerate(t) for x in ([w, "dnl"] if i % 8 == 7 else [w])))  # a mark in each line
        texts.append(" ".join(w for w in t if rng.random() < 0.8))
        texts.append(" ".join(w if rng.random() < 0.7 else rng.choice(common) for w in t) + " " + " ".join(t[: len(t) // 2]))
        texts.append(" ".join(reversed(t)))
    texts += [" ".join(texts), "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "bsd style license"]
    rows = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    for table in (rows, sf, odd):
        wanted = sorted((str(r["doc_id"]), *license_by_hand(r["text"])) for r in table.select("doc_id", "text").collect())
        assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in license_scan.scan(table).collect()) == wanted
    found = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    for n, (label, _, keys) in enumerate(license_scan.TEMPLATES):
        assert label in found[5 * n]["labels"] and found[5 * n]["score"] == 1.0
        assert not keys or label in found[5 * n + 1]["labels"], label
    assert found[len(texts) - 3]["labels"] == ["cc-by", "cc-by-nc"] and found[len(texts) - 2]["labels"] == ["apache-2.0"]
    assert found[len(texts) - 1]["labels"] == [] and license_scan.scan(none).count() == 0


def test_license_words_of_equal_frequency(spark):
    """Ties are taken in alphabetical order; whichever words are looked up, the labels are the same."""
    _, mit, _ = license_scan.TEMPLATES[0]
    table = docs_of(spark, [(i, mit, None) for i in range(3)])
    assert [tuple(r) for r in license_scan.scan(table).select("labels", "score").collect()] == [(["mit"], 1.0)] * 3


# near duplicates


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(fps))]


def test_near_duplicates_by_brute_force(sf, odd, none):
    for table in (sf, odd.where("doc_id IS NOT NULL")):
        rows = sorted(tuple(r) for r in table.select("doc_id", F.coalesce("text", F.lit(""))).collect())
        fps = [slow_fingerprint(t) for _, t in rows]
        roots = slow_components(fps)
        wanted = sorted((i, f"{fp:016x}", rows[root][0]) for (i, _), fp, root in zip(rows, fps, roots, strict=True))
        assert sorted(tuple(r) for r in near_duplicates.components(table).collect()) == wanted
    assert near_duplicates.components(none).count() == 0


def test_near_duplicates_with_null_ids(spark, odd):
    table = odd.union(docs_of(spark, [(None, "lonely words of nobody", None), (None, "the cat and the dog of the house", "en"), (None, None, None)]))
    rows = [tuple(r) for r in table.select("doc_id", F.coalesce("text", F.lit(""))).collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    roots, least = slow_components(fps), {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (i, least.get(root)) if x is not None), default=None)
    wanted = sorted(str((i, f"{fp:016x}", least[root])) for (i, _), fp, root in zip(rows, fps, roots, strict=True))
    assert sorted(str(tuple(r)) for r in near_duplicates.components(table).collect()) == wanted


@pytest.mark.parametrize(("pairwise", "one_task"), [(2000, 200_000), (4, 200_000), (4, 8)])
def test_all_ways_find_the_same_links(spark, monkeypatch, pairwise, one_task):
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(30):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 40))):
            values.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 3))):
                x ^= 1 << int(b)
    fps = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    monkeypatch.setattr(near_duplicates, "PAIRWISE", pairwise)
    monkeypatch.setattr(near_duplicates, "ONE_TASK", one_task)
    found = near_duplicates.connected(near_duplicates.links(spark.createDataFrame([(v,) for v in fps], "fp long")))
    root = {r["node"]: r["root"] for r in found.collect()}
    wanted = slow_components([v & (2**64 - 1) for v in fps])
    assert [root.get(v, v) for v in fps] == [fps[w] for w in wanted]


def test_one_of_each_group_stays(odd):
    kept = near_duplicates.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in near_duplicates.keep_first(odd.union(odd)).collect()) == [0, 1, 4, 5, 6, 7]
    # 1, 2 and 3 have no words, 5 is there twice, 6 and 8 are copies
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7]


# pipeline


def test_pipeline_stage_by_stage(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(before).count() == 0, name
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    survivors = kept.collect()
    assert all(by_hand(r["text"], items)[1] == 0 for r in survivors[:10])
    fps = [slow_fingerprint(r["text"]) for r in survivors]
    assert len(set(slow_components(fps))) == len(fps)
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert out == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in survivors}


def test_every_stage_keeps_just_the_right_rows(spark):
    labels, benchmark = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("labels", "benchmark"))
    windows = {}
    for r in benchmark.collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)

    def identified(docs, rows):
        found = language_id.train(docs, where=~held_out()).scores([t for _, t in rows])
        return {i for (i, _), (lang, score) in zip(rows, found, strict=True) if lang != language_id.UNDETERMINED and score >= 0.3}

    def civil(docs, rows):
        model = toxicity.train(docs, labels, where=~held_out())
        return {i for i, t in rows if model.scores([t])[0] < 0.5}

    def firsts(docs, rows):
        least = {}
        for (i, _), root in zip(rows, slow_components([slow_fingerprint(t) for _, t in rows]), strict=True):
            least[root] = min(i, least.get(root, i))
        return set(least.values())

    def clean(docs, rows):
        split = {i: words(t) for i, t in rows}
        return {i for i, w in split.items() if not any(tuple(w[at : at + n]) in of for n, of in windows.items() for at in range(len(w) - n + 1))}

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], (identified, civil, firsts, clean), strict=True):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = stage(spark, docs, DATA).cache()
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted(docs, rows)), name
        docs = kept


def test_stages_with_columns_of_any_name(odd, spark):
    docs = odd
    for name in ("text_hash", "component_id", "quarry_doc_id", "QUARRY_TEXT_HASH", "key", "label", "n_hit", "ids"):
        docs = docs.withColumn(name, F.lit("x"))
    assert near_duplicates.keep_first(docs).count() == near_duplicates.keep_first(odd).count()
    items = spark.createDataFrame([(1, "hund und die katze", 2)], "item_id long, text string, text_hash int")
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 7]


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
