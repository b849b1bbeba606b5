import pytest

from gristmill.naming import IdNames, data_columns, is_id_name, nested_to_text


RULES = {
    "the word alone": ["Id", " iD "],
    "the word between separators": ["id of part", "tax-ID", "lot.id.old", "shelf_id", "ID_7"],
    "a camel-case ending": ["parcelId", "lotID"],
}


@pytest.mark.parametrize("name", [n for names in RULES.values() for n in names])
def test_names_that_tell_an_identifier(name):
    assert is_id_name(name)


@pytest.mark.parametrize("name", ["idle", "fluid", "grid_size", "ideal", "LOTID", "kidney", "parcelid", "idx"])
def test_names_that_only_contain_the_letters(name):
    assert not is_id_name(name)


def test_given_ids_replace_the_name_rule():
    ids = IdNames(["o_orderkey"])
    assert "o_orderkey" in ids and "id" not in ids
    assert IdNames().first(["grid", "lot_id", "id"]) == "lot_id"


def test_nested_columns_are_refused_until_turned_into_text(spark):
    df = spark.createDataFrame([([1, 2],)], "a array<int>")
    with pytest.raises(TypeError, match="'a'"):
        data_columns(df)
    assert nested_to_text(df).first()["a"] == "[1,2]"
