import pytest

from entityloom.llm.workers import share_path

LANGS = {
    "en": "the cat and the dog were in the house with a small window that was open to the garden",
    "de": "der hund und die katze waren in dem haus mit einem kleinen fenster das offen zum garten war",
    "fr": "le chat et le chien étaient dans la maison avec une petite fenêtre ouverte sur le jardin",
}
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "n_words long, score double, found string, ids string, start long, spans string, words string"
)


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [
        (i, t, lang, "s", len(t or ""), -1, -1.0, "found", "ids", -1, "spans", "words") for i, t, lang in rows
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def edge_rows():
    """Nulls, empty, blank, very long and repeated texts, repeated and missing ids."""
    rows = []
    for i, (lang, text) in enumerate(LANGS.items()):
        for k in range(12):
            words = text.split()
            rows.append((10 * i + 100 * k, " ".join(words[k % 5 :] + words[: k % 5]) + f" {k}.", lang))
    passage = " ".join(f"word{i}" for i in range(60))
    rows += [
        (5000, None, "en"),
        (5001, "", "en"),
        (5002, " \t\n ", None),
        (5003, "!!! ??? 123", None),
        (5004, "one", "en"),
        (5005, "one two", "en"),
        (5006, passage, "en"),
        (5007, "before it " + passage + " behind it", "en"),
        (5008, passage.replace("word30", "other"), "en"),
        (5009, " ".join(["again"] * 400), "en"),
        (5010, " ".join(["again"] * 300), "en"),
        (5011, " ".join(f"long{i % 997}" for i in range(30_000)), "en"),
        (5012, "日本語 テキスト ☃ Ünïcödé ÀÉÎ É", None),
        (5013, "a<|endoftext|>b <|startoftext|>", "en"),
        (5014, passage, "en"),
        (5014, passage, "en"),
        (5015, "same id one text the cat", "en"),
        (5015, "same id other text the dog", "de"),
        (None, "no id at all and the cat", "en"),
        (None, passage, "en"),
        (None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    share_path(spark)
    return table(spark, edge_rows())


@pytest.fixture(scope="session")
def empty(spark):
    share_path(spark)
    return table(spark, [])
