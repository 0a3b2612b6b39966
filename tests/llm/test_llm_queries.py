import pytest
from conftest import DATA, compare

from skerry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    if name in queries.SQL:
        compare(df, duck, queries.SQL[name])
    else:
        df.collect()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import skerry

    root = Path(skerry.__file__).parent
    for f in root.rglob("*.py"):
        if root / "llm" not in f.parents:
            assert "skerry.llm" not in f.read_text(), f
