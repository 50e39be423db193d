"""The golden star: the mock schema of the import contract with a few hand-written rows."""

from __future__ import annotations

import datetime as dt

from starweave.plans.spec import ImportSpec, attr, cases, edge, events, lookup


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def frames(spark):
    ev = spark.createDataFrame(
        [
            (1, 10, 7, ts("2024-01-01 09:00"), ts("2024-01-01 09:30"), 5.00),
            (1, 11, 8, ts("2024-01-01 10:00"), ts("2024-01-01 10:15"), 2.50),
            (2, 10, None, ts("2024-01-02 09:00"), ts("2024-01-02 09:05"), 1.00),
            (3, 99, 7, ts("2024-01-03 09:00"), ts("2024-01-03 09:10"), 4.00),
        ],
        "CaseID int, Activity_id int, Resource_id int, StartTimestamp timestamp_ntz, "
        "EndTimestamp timestamp_ntz, EventCost double",
    )
    cs = spark.createDataFrame(
        [(1, "Ann", "A", 100.00, "North"), (2, "Bob", "B", 50.00, "South"), (4, "Cy", "A", 70.00, "North")],
        "CaseID int, CustomerName string, CustomerSegment string, InvoiceTotalAmountWithoutVAT double, Region string",
    )
    activity = spark.createDataFrame([(10, "Create"), (11, "Approve")], "Activity_id int, Activity string")
    resource = spark.createDataFrame([(7, "R7"), (8, "R8")], "Resource_id int, Resource string")
    return {"events": ev, "cases": cs, "activity": activity, "resource": resource}


def spec() -> ImportSpec:
    return ImportSpec(
        datasets=(
            events("events", ["StartTimestamp", "EndTimestamp", "EventCost"],
                   edge("CaseID", "cases", "CaseID"),
                   edge("Activity_id", "activity", "Activity_id"),
                   edge("Resource_id", "resource", "Resource_id", export_name="ResourceKey")),
            cases("cases", ["CaseID", "CustomerName", "CustomerSegment", "InvoiceTotalAmountWithoutVAT", "Region"]),
            lookup("activity", ["Activity"]),
            lookup("resource", ["Resource"]),
        ),
        attributes=(
            attr("StartTimestamp", "Date", "Start"),
            attr("EndTimestamp", "Date", "End"),
            attr("EventCost", "Float", finance="PerEvent"),
            attr("CaseID", "Integer", "Case", "Case"),
            attr("CustomerName", "String", level="Case"),
            attr("CustomerSegment", "String", level="Case"),
            attr("InvoiceTotalAmountWithoutVAT", "Float", level="Case", finance="PerCase"),
            attr("Region", "String", level="Case"),
            attr("Activity", "String", "Activity"),
            attr("Resource", "String", "Resource"),
            attr("ResourceKey", "Integer"),
        ),
    ).validate()


# The same spec as an import config document (the JSON shape the contract uses).
CONFIG = {
    "inputDataBinding": {
        "dataSource": {
            "dataSourceSchemaType": 1,
            "datasets": [
                {"Kind": 0, "Name": "events", "Path": "",
                 "Columns": [{"Name": "StartTimestamp"}, {"Name": "EndTimestamp"}, {"Name": "EventCost"}],
                 "Join": [
                     {"SourceColumnName": "CaseID", "TargetColumnName": "CaseID",
                      "TargetDatasetName": "cases", "JoinKeyType": "Integer"},
                     {"SourceColumnName": "Activity_id", "TargetColumnName": "Activity_id",
                      "TargetDatasetName": "activity", "JoinKeyType": "Integer"},
                     {"SourceColumnName": "Resource_id", "TargetColumnName": "Resource_id",
                      "TargetDatasetName": "resource", "JoinKeyType": "Integer", "ExportName": "ResourceKey"},
                 ]},
                {"Kind": 1, "Name": "cases", "Path": "",
                 "Columns": [{"Name": "CaseID"}, {"Name": "CustomerName"}, {"Name": "CustomerSegment"},
                             {"Name": "InvoiceTotalAmountWithoutVAT"}, {"Name": "Region"}],
                 "Join": None},
                {"Kind": 2, "Name": "activity", "Path": "", "Columns": [{"Name": "Activity"}], "Join": None},
                {"Kind": 2, "Name": "resource", "Path": "", "Columns": [{"Name": "Resource"}], "Join": None},
            ],
        },
        "miningMetadata": {
            "ImportConfiguration": {
                "Attributes": [
                    {"Name": a.name, "SourceDataType": a.source_data_type, "ImportType": a.import_type,
                     "Level": a.level, "FinanceImportType": a.finance,
                     "CaseLevelAttributeHandling": a.case_handling, "IsDisplayAttribute": False,
                     "IsExcluded": False, "DefaultValue": ""}
                    for a in spec().attributes
                ]
            },
            "Views": [],
        },
    },
    "reportConfiguration": {"isEmbeddedReport": True},
}
