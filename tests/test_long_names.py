"""Place names of any number of words."""

from hearthstat.operators import naming


def test_project_places_finds_names_of_more_than_six_words(spark):
    names = spark.createDataFrame([(1, 7, "Old Town By The River Bank North"), (1, 8, "Old Town")], "city_id int, neighborhood_id int, name string")
    projects = spark.createDataFrame([(1, 1, "renewal of old town by the river bank north phase two"), (2, 1, "old town square"), (3, 1, "elsewhere")], "project_id int, city_id int, project_name string")
    assert sorted(map(tuple, naming.project_places(projects, names).collect())) == [(1, 7), (2, 8), (3, None)]
