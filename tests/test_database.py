"""The catalog of a live database, by its JDBC driver, and the rules on it; statistics of saved tables."""

import uuid

import pytest

from tablewarden.config import Config
from tablewarden.evidence import Evidence
from tablewarden.rules import findings
from tablewarden.sources import catalog

STATEMENTS = (
    "create table USERS (ID int not null primary key, NAME varchar(40))",
    "create table ITEMS (ORDER_ID int not null, LINE int not null, USER_ID int, NOTE varchar(9), primary key (ORDER_ID, LINE), constraint ITEM_USER foreign key (USER_ID) references USERS (ID))",
    "create table BARE (A int)",
    "create index NOTES on ITEMS (NOTE, LINE)",
    "create unique index NAMES on USERS (NAME)",
)


@pytest.fixture
def url(spark):
    where = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(where)
    for text in STATEMENTS:
        connection.createStatement().execute(text)
    connection.close()
    return where


def test_a_live_database_is_read_and_judged(spark, url):
    found = catalog.database_catalog(spark, url, "APP")
    rows = {name: {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()} for name, df in found.items()}
    assert {(r["table_name"], tuple(r["primary_key"] or ())) for r in found["tables"].collect()} == {("USERS", ("ID",)), ("ITEMS", ("ORDER_ID", "LINE")), ("BARE", ())}
    assert {(r["table_name"], r["column_name"], r["sql_type"], r["nullable"]) for r in found["columns"].collect()} >= {("USERS", "ID", "integer", False), ("ITEMS", "NOTE", "varchar", True)} and len(rows["columns"]) == 7
    named = {r["index_name"]: (r["table_name"], r["columns"], r["is_unique"]) for r in found["indexes"].collect()}
    assert named["NOTES"] == ("ITEMS", ["NOTE", "LINE"], False) and named["NAMES"] == ("USERS", ["NAME"], True) and not any(c in (["ID"], ["ORDER_ID", "LINE"]) for _, c, _ in named.values())
    (key,) = found["foreign_keys"].collect()
    assert (key["table_name"], key["fk_name"], key["to_table"], key["columns"], key["primary_key"]) == ("ITEMS", "ITEM_USER", "USERS", ["USER_ID"], "ID")
    judged = findings(Evidence.of(spark, **found), Config(), ("table_without_primary_key", "foreign_key_without_index")).collect()
    assert {(r["code"], r["table_name"]) for r in judged} == {("table_without_primary_key", "BARE")}  # this database keeps an index behind each foreign key


def test_statistics_are_asked_for_and_not_counted(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "t"))
    name = f"t_{uuid.uuid4().hex}"
    spark.catalog.createTable(name, path=str(tmp_path / "t"), source="parquet")
    read = lambda: [r["estimated_row_count"] for r in catalog.statistics(spark, [name]).collect()]
    assert read() == [None]
    spark.sql(f"analyze table {name} compute statistics")
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert read() == [7] and catalog.statistics(spark, []).count() == 0
    spark.sql(f"drop table {name}")
