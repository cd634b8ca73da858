import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from orrery.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(data):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{name}')")
    return c


#: The tables of a catalog: their columns in DDL.
TABLES = {
    "types": "id int, base_name string, namespace string, kind string, kind_code int, source string, stored_fully_qualified_name string, base_type_path string, parent_type_id int, is_vtable boolean, is_volatile boolean, is_bitmask boolean, is_ignored boolean, source_file string, line_number int, alignment int, loaded_at timestamp_ntz",
    "type_references": "id int, type_string string, fully_qualified_type string, referenced_type_id int, is_const boolean, is_pointer boolean, is_reference boolean, pointer_depth int, is_array boolean, array_size int, source_file string, line_number int, loaded_at timestamp_ntz",
    "struct_members": "id int, struct_id int, name string, type_string string, type_reference_id int, decl_order int, member_offset int, bit_width int, alignment int, overload_index int, is_function_pointer boolean, loaded_at timestamp_ntz",
    "type_inheritances": "id int, parent_type_id int, related_type_id int, related_type_string string, ord int, loaded_at timestamp_ntz",
    "function_bodies": "id int, fully_qualified_name string, body_text string, parent_id int, body_offset long, loaded_at timestamp_ntz",
    "type_removals": "type_id int, fully_qualified_name string, removed_at timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, type_fqn string, revision int, written_at timestamp_ntz",
    "doc_labels": "doc_id long, subject string, labeller string, labelled_at timestamp_ntz",
    "subjects": "subject string, description string",
    "primitive_types": "name string",
    "split_limits": "table_name string, field_name string, max_chars int, overlap_chars int",
    "term_limits": "table_name string, field_name string, min_records int, max_record_share double",
    "mix_targets": "source string, target_share double, max_repeats int",
}


def day(n, month=1):
    return datetime.datetime(2025, month, n)


@pytest.fixture
def catalog(spark, tmp_path):
    """catalog(types=[{...}], ...): a directory with all tables; rows are dicts, what they lack is null; extra columns may be added."""

    def make(extra="", **rows):
        for name, ddl in TABLES.items():
            columns = [c.split()[0] for c in ddl.split(", ")]
            full = ddl + (f", {extra}" if extra else "")
            filled = [tuple(r.get(c) for c in columns) + ((0,) * len(extra.split(", ")) if extra else ()) for r in rows.get(name, [])]
            spark.createDataFrame(filled, full).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def same_as_sql(spark, duck, data, query, sql):
    import decimal

    def plain(x):
        if isinstance(x, (float, decimal.Decimal)):
            return f"{float(x):.6g}"
        return str(list(x)) if isinstance(x, (list, tuple)) else str(x)

    df = query(spark, data)
    names = df.columns
    ours = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in df.collect())
    found = duck.execute(sql)
    theirs_names = [c[0] for c in found.description]
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(theirs_names, r))) for r in found.fetchall())
    assert sorted(names) == sorted(theirs_names)
    assert ours == theirs
