import random

from codequarry.llm import reading

EASY = ["You can open the {0} now.", "First we type a few words.", "It is fast and small.", "Ask a friend for help.", "Then you close the {0} and wait."]
MIDDLE = ["The command reads the {0} from disk before the next step begins.", "Version 3 changes how the {0} is stored, which makes repeated queries quicker.", "Files longer than 200 lines are skipped, but larger projects may raise the limit."]
HARD = ["Irrespective of the particular methodology, the asymmetric objective regularises representational {0}.", "Contrary to conventional assumptions regarding stationarity, identifier obfuscation systematically undermines probabilistic calibration.", "Heterogeneity presupposes combinatorial tractability of the {0}."]
SETS = dict(zip(reading.LEVELS, (EASY, MIDDLE, HARD)))


def _text(rng, level, n=14):
    return " ".join(rng.choice(SETS[level]).format(rng.choice(["box", "list", "index"])) for _ in range(n))


def _made(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        level = rng.choice(reading.LEVELS)
        rows.append((i, _text(rng, level), level, "x"))
        if i % 2 == 0:
            labels += [(i, "r1", level.upper()), (i, "r2", level), (i, "r3", rng.choice([None, "unknown", *reading.LEVELS]))]
    return spark.createDataFrame(rows, "doc_id long, text string, truth string, reading_level string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level string")


def test_held_out(spark):
    docs, labels = _made(spark)
    model = reading.fit(docs, labels)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, model).collect()}
    want = {r.doc_id: r.truth for r in docs.filter("doc_id % 2 = 1").collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.97 * len(want)
    profile = reading.level_profile(reading.reading_levels(docs, model), docs, "truth").collect()
    assert sum(r.n_documents for r in profile) == 300


def test_seeded_by_formula(spark):
    docs, labels = _made(spark)
    model = reading.fit(docs, labels.limit(0))
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, model).collect()}
    truth = {r.doc_id: r.truth for r in docs.collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.6 * len(truth)


def test_what_counts(spark):
    docs, labels = _made(spark)
    model = reading.fit(docs, labels)
    rng = random.Random(7)
    base = _text(rng, "elementary")
    odd = base + " " + HARD[1] + "\n\n```\n" + "int x = 3; // " + _text(rng, "advanced") + "\n```\n"
    german = "Die Liste ist leer und der Wert wird nicht gefunden, weil das alte Format die Reihenfolge nicht behalten hat. " * 10
    assert model.level(odd)[0] == "elementary" and model.level(base.upper())[0] == "elementary"
    assert model.level("<p>" + base.replace(". ", ".</p>\n<p>") + "</p>")[0] == "elementary"
    assert model.level(german)[0] is None and model.level("```\n" + base + "\n```")[0] is None and model.level(" ".join(base.split()[:30]))[0] is None
    assert model.level(german + base)[0] == "elementary"


def test_edges(spark):
    docs, labels = _made(spark, 60)
    model = reading.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, EASY[0].format("box") * 5_000), (5, _text(random.Random(1), "advanced")), (5, _text(random.Random(1), "advanced"))], "doc_id long, text string")
    got = [(r.doc_id, r.reading_level) for r in reading.reading_levels(odd, model).orderBy("doc_id").collect()]
    assert got == [(4, "elementary"), (5, "advanced"), (5, "advanced")]
    nothing = reading.fit(docs.limit(0), labels.limit(0))
    assert reading.reading_levels(odd, nothing).count() == 0 and reading.reading_levels(docs.limit(0), model).count() == 0
    assert reading.majority_labels(spark.createDataFrame([(1, "r", "advanced"), (1, "s", "elementary"), (2, "r", None)], "doc_id long, rater string, reading_level string")).count() == 0
