import pytest

pytest.importorskip("quiver.llm.words")
