"""The core queries do not depend on the text subpackage or on what it needs."""

import subprocess
import sys

import pytest

import __spark_entry__ as E
from driftwise.plans.queries import ORACLE_SQL, QUERIES

BLOCKED = """
import sys, warnings
warnings.simplefilter("ignore")
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:{n}] == {name!r}.split("."):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
from driftwise.plans.queries import QUERIES
print(set(E.queries()) == set(QUERIES), set(E.oracle_sql()) <= set(QUERIES), "pipeline" in E.queries())
"""


@pytest.mark.parametrize("name", ["driftwise.llm", "tiktoken", "public_tokenizers"])
def test_core_queries_without_the_rest(name):
    code = BLOCKED.format(name=name, n=name.count(".") + 1)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=E.__file__.rsplit("/", 1)[0], timeout=120)
    assert out.stdout.split() == ["True", "True", "False"], out.stderr


def test_all_core_queries_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
