"""Small web tables and queries over them, for examples and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (id, header, types, rows)
TABLES = [
    (
        "1-204-7",
        ["Player", "No.", "Nationality", "Position", "Years in Club", "School/Club Team", "Points scored"],
        ["text", "real", "text", "text", "text", "text", "real"],
        [
            ["Ana Ruiz", "34", "Spain", "Guard", "2009-10", "Valencia", "12.5"],
            ["Bo Lind", "34", "Sweden", "Center", "2011-12", "Lund", "7"],
            ["Čeda Ilić", "2", "Serbia", "Guard-Forward", "1999-02", "Novi Sad", "30"],
            ["Dee Poe", None, "Canada", "Forward", "2004-05", "York (Ont.)", None],
            ["Ed Fox", "7", "Canada", "Guard", "2005-08", "Acadia", "4.5"],
        ],
    ),
    (
        "1-310-2",
        ["Pick #", "Team", "Player", "Position", "College"],
        ["real", "text", "text", "text", "text"],
        [
            ["1", "Harbour Seals", "Gil Moss", "DB", "Laval"],
            ["2", "River Kings", "Hal Noor", "QB", "Queen's"],
            ["3", "Harbour Seals", "Ian Oak", "DB", "Mount Royal"],
            ["4", "Prairie Owls", "Jo Pike", "LB", "Laval"],
            ["5", "River Kings", "Kai Quist", "RB", None],
        ],
    ),
    (
        "1-415-9",
        ["Nomination", "Actors Name", "Film Name", "Director", "Country"],
        ["text", "text", "text", "text", "text"],
        [
            ["Best Actor", "Lev Orlov", "The Long Field", "Mira Petrova", "Ukraine"],
            ["Best Actress", "Nina Sova", "Winter Tram", "Oleh Danko", "Ukraine"],
            ["Best Debut", "Paula Costa", "Marés", "Rui Dias", "Portugal"],
        ],
    ),
]

QUERIES = [
    ("1-204-7", "List players and numbers by number", "SELECT `Player`, `No.` FROM table_1_204_7 ORDER BY `No.`, `Player`"),
    ("1-204-7", "How many players of each position", "SELECT `Position`, COUNT(*) AS n FROM table_1_204_7 GROUP BY `Position` ORDER BY n DESC, `Position`"),
    ("1-204-7", "Mean starting year", "SELECT AVG(`Years in Club`) FROM table_1_204_7"),
    ("1-204-7", "Span of years", "SELECT MAX(`Years in Club`) - MIN(`Years in Club`) FROM table_1_204_7"),
    ("1-204-7", "Players above the mean", "SELECT `Player` FROM table_1_204_7 WHERE `Points scored` > (SELECT AVG(`Points scored`) FROM table_1_204_7)"),
    ("1-204-7", "Guards", "SELECT `Player`, `Nationality` FROM table_1_204_7 WHERE `Position` LIKE 'guard%' AND `Nationality` <> 'Serbia'"),
    ("1-310-2", "Picks of each team", "SELECT `Team`, COUNT(*) AS picks FROM table_1_310_2 GROUP BY `Team` HAVING COUNT(*) > 1 ORDER BY picks DESC, `Team`"),
    ("1-310-2", "Second to fourth pick", "SELECT `Player` FROM table_1_310_2 ORDER BY `Pick #` LIMIT 1, 3"),
    ("1-310-2", "Teams with a Laval player", "WITH laval AS (SELECT `Team` FROM table_1_310_2 WHERE `College` = 'Laval') SELECT DISTINCT `Team` FROM laval ORDER BY `Team`"),
    ("1-415-9", "Films by country", "SELECT `Country`, GROUP_CONCAT(`Film Name`, '; ') AS films FROM table_1_415_9 GROUP BY `Country` ORDER BY `Country`"),
]


def tables(spark: SparkSession) -> DataFrame:
    """The catalog: (id, name, header, types, rows, pos)."""
    data = [(i, "table_" + i.replace("-", "_"), h, t, r, n) for n, (i, h, t, r) in enumerate(TABLES)]
    return spark.createDataFrame(data, "id string, name string, header array<string>, types array<string>, rows array<array<string>>, pos int")


def queries(spark: SparkSession) -> DataFrame:
    """(row_id, table_id, nl, sql)."""
    return spark.createDataFrame([(n, *q) for n, q in enumerate(QUERIES)], "row_id int, table_id string, nl string, sql string")
