import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("newsmill.llm"):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "p7_found" in q and "p1_found" not in q and set(o) <= set(q)
"""


def test_without_the_training_data_operators():
    root = str(Path(entry.__file__).parent)
    assert subprocess.run([sys.executable, "-c", CODE], cwd=root).returncode == 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
