"""Small hand-made process tables covering the edge rows of FIXTURES.md §6."""

import datetime as dt

D = dt.date
TS = dt.datetime

ACTIONS = [
    # bill, date, type, text, code, committee, seq
    ("B1", D(2015, 1, 1), "IntroReferral", "Referred to Committee", "A1", "C1", 1),
    ("B1", D(2015, 1, 5), "Committee", "Reported", "A2", "C1", 2),
    ("B1", D(2015, 1, 5), "Floor", "Passed House", "A3", None, 3),        # same day as above
    ("B1", D(2015, 2, 1), "BecameLaw", "Became Public Law", "A4", None, 4),
    ("B2", D(2015, 3, 1), "IntroReferral", "Referred", "A1", "C2", 1),   # single-action bill
    ("B3", D(2015, 1, 10), None, None, "A1", "C1", 1),                   # NULL type, NULL text
    ("B3", None, "Floor", None, "A2", "C1", 2),                          # NULL date
    ("B3", D(2015, 1, 12), "becamelaw", None, "A3", "C2", 3),             # marker in lower case
    ("B4", D(2015, 4, 1), "IntroReferral", "REJECTED", "A1", "C2", 1),    # bill without sponsor
    ("B5", D(2015, 5, 1), "IntroReferral", "Rejected motion", "A1", "C3", 1),
    ("B5", D(2015, 5, 1), "Committee", "Became Public", "A2", "C3", 2),
]
ACTIONS_SCHEMA = ("bill_id string, action_date date, type string, text string, action_code string, "
                  "committee string, seq int")

BILLS = [
    ("B1", "hr", "House", TS(2015, 1, 1, 0, 0), TS(2015, 3, 2, 12, 0), D(2015, 1, 1), "An act  to do"),
    ("B2", "s", "Senate", TS(2015, 3, 1), TS(2015, 3, 1), D(2015, 3, 1), ""),
    ("B3", "hr", "House", TS(2015, 1, 10), TS(2015, 1, 8, 12, 0), D(2015, 1, 10), "x"),  # negative days
    ("B4", "s", "Senate", TS(2015, 4, 1), TS(2015, 4, 2), D(2015, 4, 1), "title"),
    ("B5", "hr", "House", TS(2015, 5, 1), TS(2015, 5, 3), D(2015, 5, 1), None),
]
BILLS_SCHEMA = ("id string, bill_type string, originchamber string, createdate timestamp, "
                "updatedate timestamp, introduceddate date, title string")

SPONSORS = [("B1", "M1"), ("B1", "M2"), ("B2", "M2"), ("B3", "M3"), ("B5", "M1")]
MEMBERS = [("M1", "R", "CA"), ("M2", "D", "NY"), ("M3", "R", "CA")]
COMMITTEES = [("C1", "Rules"), ("C2", "Budget"), ("C3", "Budget")]   # name not unique


def tables(spark):
    from caseflow.sources.tables import ProcessTables
    return ProcessTables(
        bills=spark.createDataFrame(BILLS, BILLS_SCHEMA),
        actions=spark.createDataFrame(ACTIONS, ACTIONS_SCHEMA),
        sponsors=spark.createDataFrame(SPONSORS, "bill_id string, sponsor_id string"),
        members=spark.createDataFrame(MEMBERS, "bioguideid string, party string, state string"),
        committees=spark.createDataFrame(COMMITTEES, "id string, name string"),
    )
