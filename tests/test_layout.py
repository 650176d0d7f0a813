"""The training-data operators are optional: nothing else imports them."""

import pathlib
import re

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_library_does_not_import_the_optional_package():
    for path in (ROOT / "tardy").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tardy\.llm|from \.llm|corpus_pipeline", path.read_text()), path


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from tardy.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
