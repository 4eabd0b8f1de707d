"""Classes, tools, and the fixed tables that relate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The classes in their order.
CLASSES = ("reentrancy", "access_control", "arithmetic", "unchecked_calls", "dos")
#: The classes' names for readers. A class's catalogue number is its place, from 1.
DISPLAY_NAMES = {
    "reentrancy": "Reentrancy",
    "access_control": "Access Control",
    "arithmetic": "Integer Overflow/Underflow",
    "unchecked_calls": "Unchecked Low-Level Calls",
    "dos": "Denial of Service (DoS)",
}
#: The tools in their order.
TOOLS = ("slither", "mythril", "securify", "osiris")
#: The classes that each tool's silence speaks about.
COVERAGE = {
    "slither": ("reentrancy", "access_control", "unchecked_calls", "dos"),
    "mythril": ("reentrancy", "access_control", "unchecked_calls", "dos"),
    "securify": ("reentrancy", "access_control", "unchecked_calls", "dos"),
    "osiris": ("arithmetic",),
}
#: Finding identifiers of each tool and their class.
FINDINGS = {
    "slither": {
        "reentrancy-eth": "reentrancy",
        "reentrancy-no-eth": "reentrancy",
        "reentrancy-benign": "reentrancy",
        "reentrancy-events": "reentrancy",
        "reentrancy-unlimited-gas": "reentrancy",
        "arbitrary-send": "access_control",
        "arbitrary-send-eth": "access_control",
        "suicidal": "access_control",
        "tx-origin": "access_control",
        "unprotected-upgrade": "access_control",
        "unchecked-lowlevel": "unchecked_calls",
        "unchecked-send": "unchecked_calls",
        "unchecked-transfer": "unchecked_calls",
        "calls-loop": "dos",
        "locked-ether": "dos",
    },
    "mythril": {
        "SWC-107": "reentrancy",
        "SWC-105": "access_control",
        "SWC-106": "access_control",
        "SWC-115": "access_control",
        "SWC-112": "access_control",
        "SWC-124": "access_control",
        "SWC-101": "arithmetic",
        "SWC-104": "unchecked_calls",
        "SWC-113": "dos",
        "SWC-128": "dos",
    },
    "securify": {
        "DAO": "reentrancy",
        "DAOConstantGas": "reentrancy",
        "UnrestrictedWrite": "access_control",
        "UnrestrictedSelfdestruct": "access_control",
        "TODReceiver": "access_control",
        "MissingInputValidation": "unchecked_calls",
        "UnhandledException": "unchecked_calls",
        "UnrestrictedEtherFlow": "unchecked_calls",
        "LockedEther": "dos",
    },
    "osiris": {
        "Overflow bugs": "arithmetic",
        "Underflow bugs": "arithmetic",
        "Division bugs": "arithmetic",
        "Modulo bugs": "arithmetic",
        "Truncation bugs": "arithmetic",
        "Signedness bugs": "arithmetic",
    },
}
#: Annotation categories in scope and their class.
CATEGORIES = {
    "reentrancy": "reentrancy",
    "access_control": "access_control",
    "arithmetic": "arithmetic",
    "unchecked_low_level_calls": "unchecked_calls",
    "denial_of_service": "dos",
}
#: Selection quotas as shares of the selection.
QUOTAS = {"arithmetic": 0.28, "dos": 0.18, "access_control": 0.18, "reentrancy": 0.20, "unchecked_calls": 0.20}
MANIFEST_COLUMNS = ("contract_id", "path", "chash", *CLASSES)


def classes(spark: SparkSession) -> DataFrame:
    """(class, idx)."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(CLASSES)], "class string, idx int")


def coverage(spark: SparkSession) -> DataFrame:
    """(tool, flaw): pairs in which the tool's silence is a vote."""
    return spark.createDataFrame([(t, f) for t in TOOLS for f in COVERAGE[t]], "tool string, flaw string")


def finding_map(spark: SparkSession) -> DataFrame:
    """(tool, ident, flaw)."""
    return spark.createDataFrame([(t, i, f) for t, m in FINDINGS.items() for i, f in m.items()], "tool string, ident string, flaw string")


def display_name(code: str) -> str:
    """A class's name for readers; an unknown code raises."""
    return DISPLAY_NAMES[code]
