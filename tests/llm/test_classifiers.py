import numpy as np
import pytest

from marketsense.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, Score double, label string"
EDGES = [(90, None), (91, ""), (92, "12 34 --"), (None, "the word of the day"), (93, "the word of the day"), (93, "the word of the day"), (94, "the " * 60000), (95, "日本語 текст")]


def edge_frame(spark):
    return spark.createDataFrame([(i, t, None, None, 0.5, "x") for i, t in EDGES], DOCS)


def held_out(spark, query, label):
    got = query(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return got[got.held_out].merge(known, on="doc_id"), label


def test_language_accuracy(spark):
    got = queries.op9_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.rejected.mean() < 0.01


def test_language_edges(spark):
    rows = [(i, text, lang, None, 0.0, "") for i in range(80) for text, lang in [("the house of the king " * 3, "en"), ("das haus der königin ist ", "de")]]
    model = language.train(spark.createDataFrame(rows + [(200, None, "en", None, 0.0, ""), (201, "plain", None, None, 0.0, "")], DOCS))
    assert model.names == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(edge_frame(spark), model).collect()]
    assert len(got) == len(EDGES)
    assert {g for g in got if g[0] in (90, 91, 92)} == {(90, "und", True), (91, "und", True), (92, "und", True)}
    assert [g[1] for g in got if g[0] == 93] == ["en", "en"] and all(g[1] in model.names for g in got if g[0] in (94, 95))
    kept = language.keep_identified(edge_frame(spark), model)
    assert kept.columns == edge_frame(spark).columns and kept.filter("doc_id in (90, 91, 92)").count() == 0
    assert kept.filter("doc_id = 93").count() == 2
    untrained = language.train(edge_frame(spark))
    assert {r.lang_pred for r in language.identify(edge_frame(spark), untrained).collect()} == {"und"}
    assert language.identify(edge_frame(spark).limit(0), model).collect() == []


def test_quality_accuracy(spark):
    held, _ = held_out(spark, queries.op10_boosted_quality, "quality")
    assert (held.predicted == held.quality).mean() > 0.95


def test_flat_trees_equal_nested_walk():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 6)), rng.integers(0, 2, 400).astype(float)
    y[x[:, 2] > 0.3] = 1
    forest = quality.fit(x, y, np.ones(400), trees=12, depth=3)

    def walk(row):
        margin = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert forest.scores(x) == pytest.approx([walk(row) for row in x])
    assert (forest.scores(x)[x[:, 2] > 0.3] > 0.5).mean() > 0.95  # the other labels are coin tosses


def test_quality_edges(spark):
    labels = spark.createDataFrame([(93, 1, 0), (None, 0, 1), (94, None, None), (95, 0, 1), (93, 0, 0)], "doc_id long, quality int, toxic int")
    docs = edge_frame(spark)
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (90, 91)}) == 1
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_toxicity_accuracy(spark):
    held, _ = held_out(spark, queries.op3_restored_toxicity, "toxic")
    assert (held.predicted == held.toxic).mean() > 0.85


LETTERS = ["stupid idiot loser trash people under the other house", "read words worthless disgusting pathetic"]


def test_decoding_restores_disguises(spark):
    counts = toxicity.letter_trigrams(spark.createDataFrame([(t,) for t in LETTERS * 20] + [(None,)], "text string"))
    model = toxicity.language_model(counts).tolist()
    disguises = {"1d1ot": "idiot", "st.u.p.i.d": "stupid", "stuuupid": "stupid", "$tupid": "stupid", "l0ser": "loser", "p@th3tic": "pathetic", "w0rthless": "worthless"}
    for seen, meant in disguises.items():
        assert toxicity.decode(seen, model) == meant
    words = toxicity.restored_words("You s t u p i d, tr@sh!! house 2024 u-n-d-e-r", model, {})
    assert {"stupid", "trash", "house", "under"} <= words
    assert toxicity.restored_words(None, model, {}) == set()


def test_decoding_finds_the_likeliest_path():
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS))).tolist()

    def paths(token, place=0):
        """All (text, cost) readings of a token, one sign after the other."""
        if place == len(token):
            yield "", 0.0
            return
        char = token[place]
        ways = [(char, toxicity.PLAIN)] if char.isalpha() else []
        ways += [(letter, toxicity.SWAP) for letter in toxicity.LOOKALIKES.get(char, "")]
        if char in toxicity.MARKS or not ways:
            ways.append(("", toxicity.MARK))
        elif char.isalpha() and place and token[place - 1] == char:
            thrice = token[place - 2 : place] == 2 * char or token[place : place + 2] == 2 * char
            ways.append(("", toxicity.REPEAT if thrice else toxicity.DOUBLE))
        for text, cost in ways:
            for rest, more in paths(token, place + 1):
                yield text + rest, cost + more

    def score(text, cost):
        seen = [0, 0, *map(toxicity.symbol_of, text), 0]
        return cost + sum(model[a][b][c] for a, b, c in zip(seen, seen[1:], seen[2:]))

    for token in ["a1b", "l1ll0", "$s-s!", "aab.b", "1|1", "é3ee", "s...t"]:
        best = max(score(*path) for path in paths(token))
        found = toxicity.decode(token, model)
        assert max(score(*path) for path in paths(token) if path[0] == found) == pytest.approx(best)


def test_toxicity_edges(spark):
    rows = [(i, f"a plain text of the day number {i}", None, None, 0.0, "") for i in range(100)] + [(200 + i, f"you are an idi0t and more {i}", None, None, 0.0, "") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).union(edge_frame(spark))
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(EDGES)
    assert all(r.predicted == int(r.doc_id >= 200) for r in got if r.doc_id is not None and (r.doc_id < 90 or r.doc_id >= 200))
    assert len({r.score for r in got if r.doc_id in (90, 91)}) == 1
    bare = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, bare).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


@pytest.fixture(scope="module")
def spoken(spark):
    """Letter model of sf0.01 and of sentences with the words that are disguised."""
    said = ["you are a stupid man", "i hate you", "an idiot and a stupid idiot", "everyone knows it here"] * 400
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in said], "text string"))
    return toxicity.language_model(toxicity.letter_trigrams(docs)).tolist()


@pytest.mark.parametrize(
    "seen, meant",
    [
        ("you are a s t u p i d man", {"stupid", "man", "you", "a"}), ("i h a t e you", {"i", "hate", "you"}), ("i d i o t s t u p i d", {"idiot", "stupid"}),
        ("$ t u p i d", {"stupid"}), ("s t u p ! d", {"stupid"}), ("s\tt\nu\tp\ni\td", {"stupid"}), ("an id iot", {"idiot"}), ("s t u p ii d", {"stupid"}),
    ],
)
def test_spaced_words_are_restored(spoken, seen, meant):
    assert meant <= toxicity.restored_words(seen, spoken, {})


def test_long_tokens_are_restored(spoken):
    words = lambda text: toxicity.restored_words(text, spoken, {})
    assert "stupid" in words("st" + "u" * 60 + "pid")
    assert "stupid" in words(".-.-.-.-.-".join("stupid"))
    assert {"you", "are", "idiot", "everyone", "knows", "here"} <= words("you.are.an.id1ot.and.everyone.knows.it.here")


def test_sampled_weights_are_kept_without_zeros():
    rows = np.zeros((3, language.BUCKETS), np.float16)
    rows[0, [3, 8000]], rows[2, 5] = [0.5, 0.25], 1
    packed = [(np.flatnonzero(row).astype(np.uint16).tobytes(), row[row != 0].tobytes()) for row in rows]
    held = language.WeightRows(packed)
    assert held[np.array([2, 0, 1])].tolist() == rows[[2, 0, 1]].tolist() and held.weights.nbytes + held.buckets.nbytes == 12
