import pytest

from glyphmill.llm import pii


@pytest.fixture(scope="session")
def trained():
    """The personal-data network with production parameters, trained once for all tests."""
    return pii.fit(["the words of a text that carries them along and more of it still", "und noch mehr Worte in einem Text"] * 3)
