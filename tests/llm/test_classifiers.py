import random

import numpy as np

from cleanlake.llm import language, toxicity
from cleanlake.llm.language import Model, automaton, identify, phrases, samples
from cleanlake.llm.toxicity import Folder, Lexicon, Matcher, learn, logistic, score, spaced
from cleanlake.llm.shared import hash_code, lowest
from llm_data import SCHEMA

SF = "/root/testdata/sf0.01"


def longest_match_phrases(text, sample, known):
    """Greedy parse by substring search."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_parsing_finds_longest_matches():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sample = "".join(rng.choice(list("abc"), 60))
        text = "".join(rng.choice(list("abcd"), rng.integers(0, 90)))
        code = {c: i for i, c in enumerate("abcd")}
        parse = language.parser(automaton([code[c] for c in sample], 4))
        codes = np.array([code[c] for c in text], np.uint8)
        got = phrases(codes, np.array([0]), np.array([len(text)]), parse, 4)
        assert got[0] == longest_match_phrases(text, sample, code)


def test_odd_texts_have_a_language(docs, odd_texts):
    model = Model({"en": "the cat sat on the mat " * 40, "fr": "le chat est sur le tapis " * 40})
    rows = identify(docs(odd_texts), model).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert identify(docs(odd_texts), Model({})).where("lang_pred <> 'und'").count() == 0


def test_language_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert samples(none) == {}
    assert identify(none, Model({"en": "abc"})).count() == 0


def test_a_rare_label_leaves_the_other_samples_whole(spark):
    rng = np.random.default_rng(2)

    def text(letters, size):
        words = ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(size)]
        return " ".join(words)

    rows = [(i, text("abcdefgh", 400), "one") for i in range(60)]
    rows += [(100 + i, text("ijklmnop", 400), "two") for i in range(60)]
    big = samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang: len(t) for lang, t in big.items()} == {"one": 40_000, "two": 40_000}
    assert all(max(map(len, t.split("\n"))) > 1_000 for t in big.values()), "texts are taken whole"
    rows += [(200, text("qrstuvwx", 50)[:300], "rare"), (201, "ok", "typo")]
    found = samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: found[k] for k in big} == big
    assert found["rare"] == rows[-2][1] and found["typo"] == "ok"


def test_rates_allow_for_the_size_of_samples():
    docs = texts_by_language()
    whole = {lang: "\n".join(texts[::2])[:40_000] for lang, texts in docs.items()}
    unseen = [(lang, t) for lang, texts in docs.items() for t in texts[1:60:2]]
    some = Model({**whole, "typo": "ok", "fr": whole["fr"][:300], "eng": whole["en"][-300:]})
    rates = some.rates([t for _, t in unseen])
    got = [some.languages[i] for i in rates.argmin(axis=1)]
    assert np.mean([a == lang for a, (lang, _) in zip(got, unseen)]) > 0.97


def texts_by_language():
    import pyarrow.parquet as pq

    out = {}
    for r in pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pylist():
        if r["lang"] and r["text"] and language.has_letters(r["text"]):
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def test_language_by_text_alone(spark):
    out = language.op5_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    unseen = both[both.held_out & both.lang.notna()]
    assert len(out) == len(docs)
    assert (unseen.lang == unseen.lang_pred).mean() > 0.97


def test_folding():
    fold = Folder().fold
    assert fold("L0SER") == fold("loser") == "ioser"
    assert fold("ѕtupіd") == fold("stupid")
    assert fold("çà") == "ca" and fold("café") == "cafe"
    assert spaced(fold("a-b\n c")) == " a b c "


def test_exceptions_cover_entries():
    matcher = Matcher(Lexicon({" bad": 2.0, " evil ": 3.0}, frozenset({" not bad "}), (-3.0, 2.0, 1.0)))
    assert [h[2] for h in matcher.hits(" so bad and evil ")] == [2.0, 3.0]
    assert matcher.hits(" not bad at all ") == []
    assert matcher.score("so bad") > matcher.score("so bad " + "and so on " * 300) > matcher.score("")
    assert matcher.score(None) == matcher.score("fine")


def test_learned_lexicon(spark, docs, odd_texts):
    rows = []
    for i in range(80):
        text = f"some words about number{i} and the usual things of every day"
        rows.append((text + " you grobnik" + "ovsky"[: i % 5] if i % 2 else text, i % 2))
    # In a fixed phrase the word is harmless.
    rows += [(f"the grobnik tower of town{i} is old", 0) for i in range(30)]
    rows += [(None, 1), ("", 0), ("no label", None)]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    labelled = spark.createDataFrame(numbered, "doc_id long, text string, toxic int")
    lexicon = learn(labelled.drop("toxic"), labelled.drop("text"))
    matcher = Matcher(lexicon)
    assert matcher.score("you gr0bn1k") >= 0.3 > matcher.score("the grobnik tower stands")
    assert matcher.score("some words of every day") < 0.3
    out = score(docs(odd_texts), lexicon).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= 0.3) for r in out)


def test_null_ids_take_no_place_in_the_samples(spark):
    rows = [(i, f"plain words of text{i}" + " you grobnik" * (i % 2), i % 2) for i in range(160)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    nulls = spark.range(600).selectExpr("cast(null as long) as doc_id", "int(id % 2) as toxic")
    labels = labelled.drop("text").unionByName(nulls)
    lexicon = learn(labelled.drop("toxic"), labels, most=60)
    assert lexicon == learn(labelled.drop("toxic"), labelled.drop("text"), most=60)
    assert Matcher(lexicon).score("you grobnik") >= 0.3

    texts = [(None if i < 900 else i, f"text number{i} has some words", "en") for i in range(1000)]
    texts += [(None, "the same text many times", "en")] * 500
    known = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = samples(known, docs=50)["en"].split("\n")
    assert len(found) == 50
    numbers = [int("".join(c for c in t if c.isdigit()) or 0) for t in found]
    assert sum(n >= 900 for n in numbers) < 20 and found != sorted(found)


def test_many_toxic_phrases_leave_room_for_exceptions(spark):
    rows = [(f"you grobnik word{'abcdefghij'[k % 10] * (1 + k // 10)}", 1) for k in range(60) for _ in range(3)]
    rows += [("the grobnik tower is old", 0)] * 30 + [("some words of every day", 0)] * 370
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    lexicon = learn(labelled.drop("toxic"), labelled.drop("text"))
    assert lexicon.exceptions == {" the grobnik ", " grobnik tower "}


def test_nothing_to_learn(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, toxic int")
    lexicon = learn(nothing, nothing)
    assert lexicon == Lexicon()
    assert score(spark.createDataFrame([], SCHEMA), lexicon).count() == 0
    constant, *factors = logistic([(0.0, 0.0, 0), (1.0, 0.0, 1), (0.0, 0.0, 0)])
    assert constant < 0 and min(factors) >= 0


def test_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.op6_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").toPandas()
    unseen = out.merge(labels.dropna(), on="doc_id").query("held_out")
    caught = unseen[unseen.toxic == 1].predicted.mean()
    blamed = unseen[unseen.toxic == 0].predicted.mean()
    assert caught > 0.9 and blamed < 0.02


def test_lowest_codes_of_each_value(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 100 = 0 then 'rare' else 'often' end as kind")
    for most in (1, 30, 700):
        found = lowest(rows, "kind", hash_code("id"), most)
        counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
        assert counts["rare"] == 50 if most > 50 else most <= counts["rare"] <= 2 * most
        assert most <= counts["often"] <= 2 * most
        lost = rows.withColumn("_code", hash_code("id")).join(found.select("id"), "id", "left_anti")
        worst = found.groupBy("kind").agg({"_code": "max"}).withColumnRenamed("max(_code)", "worst")
        assert lost.join(worst, "kind").where("_code <= worst").count() == 0
    same = spark.range(900).selectExpr("1L as id", "'x' as kind")
    assert lowest(same, "kind", hash_code("id"), 10).count() == 900, "equal codes stay together"
    assert lowest(rows.limit(0), "kind", hash_code("id"), 10).count() == 0


def test_many_rows_of_one_id_stay_a_bounded_sample(spark):
    """One labelled id has thousands of rows: its texts are a sample of its class, each once."""
    rows = [(1, f"text {k % 3000} vile" if k % 2 else f"text {k % 3000}") for k in range(6_000)]
    rows += [(10 + k, f"a kind word number {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *[(10 + k, 0) for k in range(50)], (10, 1), (None, 1), (11, None)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, "doc_id", "text", 20)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert 20 <= sizes[1] <= 40 and 20 <= sizes[0] <= 40
    assert sample.count() == sample.distinct().count()
    whole = toxicity._sample(docs, labels, "doc_id", "text", 100_000)
    assert whole.where("toxic = 1").count() == 3_001 and whole.where("toxic = 0").count() == 50
    assert 0 <= score(docs, learn(docs, labels, most=20)).first()["score"] <= 1


def test_matches_by_brute_force():
    """Entries and exceptions looked for at every place of the folded text."""
    chance = random.Random(12)
    word = lambda: "".join(chance.choice("abc") for _ in range(chance.randint(1, 4)))
    for _ in range(300):
        entries = {" " + word() + chance.choice(["", " "]): chance.randint(1, 9) / 2 for _ in range(4)}
        phrases = frozenset(f" {word()} {word()} " for _ in range(4))
        text = spaced(" ".join(word() for _ in range(chance.randint(0, 12))))
        safe = [(i, i + len(p)) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        want = []
        for i in range(len(text)):
            own = [(w, -len(e), e) for e, w in entries.items() if text.startswith(e, i)]
            if own:
                heaviest = max(w for w, *_ in own)
                covered = [not any(a <= i and i + len(e) <= b for a, b in safe) for w, _, e in own if w == heaviest]
                if len(set(covered)) == 1 and covered[0]:
                    want.append((i, heaviest))
                elif len(set(covered)) > 1:
                    want = None  # equally heavy entries of two lengths, one covered: either will do
                    break
        if want is not None:
            assert [(a, w) for a, _, w in Matcher(Lexicon(entries, phrases)).hits(text)] == want
