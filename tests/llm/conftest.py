import os

import pytest

TOKENIZERS = os.environ.get("HERONRY_TOKENIZERS", "/opt/tokenizers")


@pytest.fixture(scope="session")
def tokenizer_file():
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    return path
