import pytest


@pytest.fixture(scope="session")
def docs_rows():
    """Edge cases that every text operator must take."""
    return [
        (1, "The cat's 12 mats,  sat.\n\nOn\tmats \n", "en", "a", 3),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "plain words here\nnext line of words", "en", "a", 5),
        (5, "plain words here\nnext line of words", "en", "a", 5),
        (6, "é ü 漢字 ½ ² x y \x85z <|endoftext|> 'll don't", "en", "a", 5),
        (7, "a" * 700 + " b", "en", "a", 5),
    ]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
