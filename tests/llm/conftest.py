import pytest


@pytest.fixture(scope="session")
def tokenizer():
    from minutebook.llm.queries import tokenizer_path
    return tokenizer_path()
