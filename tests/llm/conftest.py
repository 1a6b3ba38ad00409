import os

import pytest

from tidelog.llm.tokenize import VOCABULARY


@pytest.fixture(scope="session")
def vocabulary():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    return VOCABULARY
