import pytest

from lanelytics.llm.common import ship

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_tokens string, fp string, part string, grp string, "
    "text_key string, score string, salt string, path string, counts string, n_words string, component_id string"
)
CLASHING = ("x",) * 11


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names the operators use themselves."""

    def build(*rows):
        full = [(*row, *(None,) * (4 - len(row)), *CLASHING) for row in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


PROSE = "the quick brown fox jumps over a lazy dog while seven small birds sing near an old stone wall tonight "
#: Nulls, empty and blank texts, repeated rows, rows without id, unusual characters, special strings and long texts.
EDGE_ROWS = [
    (1, "plain words here", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "en", None),
    (5, "plain words here", "en", "a"),
    (5, "plain words here", "en", "a"),
    (None, "no id  at all", "en", "b"),
    (None, "no id  at all", "en", "b"),
    (7, "a <|endoftext|> b <|startoftext|>c", "en", "b"),
    (8, "l'été   coûte 12€ \x1c x\x1fy 漢字 ελληνικά 🙂🙂\r\n\r\n  end", "fr", "b"),
    (9, PROSE * 3000, "en", "c"),
    (10, "x" * 70000, "en", "c"),
    (11, "it's we'll I'M   ...   !!!\n\n\n\nDone\n", "en", "c"),
]
