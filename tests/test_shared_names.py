"""What the sources of a listing build share."""

import pytest

import __spark_entry__ as entry
from parcelflow.operators import resolve
from parcelflow.plans import listings, prepare


def test_names_and_coordinates_are_made_ready_once_for_all_sources(spark, folder, monkeypatch):
    tables, joins = [], []
    table, attach = resolve._table, resolve.attach_coordinates
    monkeypatch.setattr(resolve, "_table", lambda *x: tables.append(x) or table(*x))
    for module in (resolve, prepare, listings):
        monkeypatch.setattr(module, "attach_coordinates", lambda *x: joins.append(x) or attach(*x), raising=False)
    queries = entry.queries()
    found = sorted(queries["cleaned_listings_table"](spark, folder).collect(), key=str)
    assert (len(tables), len(joins)) == (1, 1)
    assert found == sorted(queries["cleaned_listings"](spark, folder).collect(), key=str)


@pytest.mark.parametrize("names", [["NEW-TOWN", "OLD TOWN"], ["NEW TOWN", "OLD TOWN"]])
def test_hyphens_make_another_way_of_looking_only_where_there_are_any(spark, names):
    dictionary = spark.createDataFrame(list(enumerate(names)), "priority int, name string")
    made = resolve.NameTables(dictionary)
    df = spark.createDataFrame([("TO NEW TOWN",), ("TO NEW-TOWN",), ("OLD TOWN",)], "t string")
    for spaces in (True, False, True):
        shared = resolve.first_match_join(df, "t", dictionary, "hit", hyphen_as_space=spaces, inline=0, made=made)
        own = resolve.first_match_join(df, "t", dictionary, "hit", hyphen_as_space=spaces, inline=0)
        assert sorted(shared.collect(), key=str) == sorted(own.collect(), key=str)
    assert len(made.made) == (2 if "-" in names[0] else 1)
    by_space = {r["t"]: r["hit"] for r in resolve.first_match_join(df, "t", dictionary, "hit", hyphen_as_space=True, inline=0, made=made).collect()}
    assert by_space == {"TO NEW TOWN": names[0], "TO NEW-TOWN": None, "OLD TOWN": "OLD TOWN"}
