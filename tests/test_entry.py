import ast
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")
CORE = ["p5_found", "dedup_canonical", "keyword_screen", "version_history", "asof_all_days", "gap_segments", "x_star_join", "x_sessions", "json_store", "reading_index", "quality_violations", "column_progress", "html_attachments", "pdf_files"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "loomwright").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_the_core_works_without_the_subpackage():
    code = "import sys; sys.modules['loomwright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert found == sorted(map(repr, expected))


def test_scratch_is_shared_and_cleared(spark):
    from loomwright.session import clear_scratch, materialise, scratch, shared_dir

    df = materialise(spark.range(3), "t")
    assert df.count() == 3 and scratch(spark, "x").startswith(shared_dir(spark)) and scratch(spark, "x") != scratch(spark, "x")
    clear_scratch(spark)
    with pytest.raises(Exception, match="NOT_EXIST|does not exist|FileNotFound"):
        materialise(spark.range(3), "t").count() and df.count()


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
