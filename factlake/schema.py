"""Table schemas, natural keys and the fixed vocabularies of the analyses.

Everything in the "fixed values" blocks must equal the published data-set
definitions (column names and orders of the quarterly files, XBRL tag names,
form types) for results to be right; they are stated plainly, in natural
order, and not derived.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Column order of the four quarterly files / lake tables.
# --------------------------------------------------------------------------
SUB_COLUMNS = [
    "adsh", "cik", "name", "sic",
    "countryba", "stprba", "cityba", "zipba", "bas1", "bas2", "baph",
    "countryma", "stprma", "cityma", "zipma", "mas1", "mas2",
    "countryinc", "stprinc", "ein", "former", "changed",
    "afs", "wksi", "fye", "form", "period", "fy", "fp",
    "filed", "accepted", "prevrpt", "detail", "instance", "nciks", "aciks",
]
TAG_COLUMNS = ["tag", "version", "custom", "abstract", "datatype",
               "iord", "crdr", "tlabel", "doc"]
NUM_COLUMNS = ["adsh", "tag", "version", "ddate", "qtrs", "uom",
               "segments", "coreg", "value", "footnote"]
PRE_COLUMNS = ["adsh", "report", "line", "stmt", "inpth", "rfile",
               "tag", "version", "plabel", "negating"]

TABLE_COLUMNS = {"sub": SUB_COLUMNS, "tag": TAG_COLUMNS,
                 "num": NUM_COLUMNS, "pre": PRE_COLUMNS}

# Natural keys (no surrogate keys anywhere).
KEYS = {
    "sub": ["adsh"],
    "tag": ["tag", "version"],
    "num": ["adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "coreg"],
    "pre": ["adsh", "report", "line"],
}

# Columns whose NULL drops the row during cleaning (sub has none: a NULL in a
# required sub column fails the whole quarter instead).
DROP_IF_NULL = {
    "tag": ["tag", "version"],
    "num": ["adsh", "tag", "version", "ddate", "qtrs", "uom"],
    "pre": ["adsh", "report", "line", "tag", "version"],
}

# Required (NOT NULL) columns per table, checked by the quality jobs.
REQUIRED = {
    "sub": ["adsh", "cik", "name", "wksi", "form", "filed", "accepted",
            "prevrpt", "detail", "instance", "nciks"],
    "tag": ["tag", "version", "custom", "abstract"],
    "num": ["adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "coreg"],
    "pre": ["adsh", "report", "line", "inpth", "rfile", "tag", "version", "negating"],
}

# Typed lake schemas (the cleaning step produces exactly these).
_S, _L, _I, _H, _B = T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()
_D, _TS, _DEC = T.DateType(), T.TimestampNTZType(), T.DecimalType(28, 4)

_SUB_TYPES = {"cik": _L, "sic": _I, "changed": _D, "wksi": _B, "period": _D,
              "fy": _H, "filed": _D, "accepted": _TS, "prevrpt": _B,
              "detail": _B, "nciks": _I}
_TAG_TYPES = {"custom": _B, "abstract": _B}
_NUM_TYPES = {"ddate": _D, "qtrs": _H, "value": _DEC}
_PRE_TYPES = {"report": _H, "line": _H, "inpth": _B, "negating": _B}


def _struct(columns, types):
    return T.StructType([T.StructField(c, types.get(c, _S), True) for c in columns])


SUB_SCHEMA = _struct(SUB_COLUMNS, _SUB_TYPES)
TAG_SCHEMA = _struct(TAG_COLUMNS, _TAG_TYPES)
NUM_SCHEMA = _struct(NUM_COLUMNS, _NUM_TYPES)
PRE_SCHEMA = _struct(PRE_COLUMNS, _PRE_TYPES)
SCHEMAS = {"sub": SUB_SCHEMA, "tag": TAG_SCHEMA, "num": NUM_SCHEMA, "pre": PRE_SCHEMA}

# --------------------------------------------------------------------------
# Text markers read as NULL by the original loader (its two
# explicit markers plus the default NA list of the pandas CSV reader).
# --------------------------------------------------------------------------
NULL_MARKERS = [
    "", "\\N",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --------------------------------------------------------------------------
# Form types and XBRL concept synonyms used by the analyses.
# --------------------------------------------------------------------------
ANNUAL_FORMS = ["10-K", "10-K/A"]
FORM_10K = "10-K"
FORM_10KA = "10-K/A"

CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "cogs": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "gross_profit": ["GrossProfit"],
    "rd": ["ResearchAndDevelopmentExpense"],
    "sga": ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
    "op_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "net_income_any": ["NetIncomeLoss", "ProfitLoss",
                       "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities",
            "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment",
              "PaymentsToAcquireProductiveAssets"],
    "pretax_income": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ],
    "income_tax": ["IncomeTaxExpenseBenefit"],
}

# Expense tags ranked per filing by the top-expenses analysis.
EXPENSE_TAGS = [
    "CostOfRevenue",
    "CostOfGoodsAndServicesSold",
    "ResearchAndDevelopmentExpense",
    "SellingGeneralAndAdministrativeExpense",
    "GeneralAndAdministrativeExpense",
    "SellingAndMarketingExpense",
    "OperatingExpenses",
    "OtherOperatingExpenses",
    "DepreciationAndAmortization",
    "MarketingExpense",
    "AdvertisingExpense",
]

# Default entity lists of the analyses (public company identifiers).
MEGACAP_CIKS = [320193, 789019, 1652044, 1018724, 1326801]
MEGACAP_CIKS_WITH_BRK = [320193, 789019, 1652044, 1018724, 1326801, 1067983]
SECTOR_SICS = [2834, 7372, 6022, 7370, 1311]
BLANK_CHECK_SIC = 6770
