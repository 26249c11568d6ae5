"""Transformation codes and groups of the monthly macroeconomic panel, as dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODES = frozenset(range(1, 8))

#: Series by transformation code. Fixed values.
SERIES_OF_CODE = {
    1: [
        "CES0600000007", "COMPAPFFx", "TB3SMFFM", "TB6SMFFM", "T1YFFM", "T5YFFM", "T10YFFM", "AAAFFM", "BAAFFM", "VIXCLSx", "AWHMAN",
    ],
    2: [
        "CUMFNS", "HWI", "HWIURATIO", "UNRATE", "UEMPMEAN", "CONSPI", "S&P div yield", "FEDFUNDS", "CP3Mx", "TB3MS", "TB6MS", "GS1", "GS5", "GS10",
        "AAA", "BAA", "UMCSENTx", "AWOTMAN", "ISRATIOx",
    ],
    4: [
        "HOUST", "HOUSTNE", "HOUSTMW", "HOUSTS", "HOUSTW", "PERMIT", "PERMITNE", "PERMITMW", "PERMITS", "PERMITW",
    ],
    5: [
        "RPI", "W875RX1", "DPCERA3M086SBEA", "CMRMTSPLx", "RETAILx", "INDPRO", "IPFPNSS", "IPFINAL", "IPCONGD", "IPDCONGD", "IPNCONGD", "IPBUSEQ",
        "IPMAT", "IPDMAT", "IPNMAT", "IPMANSICS", "IPB51222S", "IPFUELS", "CLF16OV", "CE16OV", "UEMPLT5", "UEMP5TO14", "UEMP15OV", "UEMP15T26",
        "UEMP27OV", "CLAIMSx", "PAYEMS", "USGOOD", "CES1021000001", "USCONS", "MANEMP", "DMANEMP", "NDMANEMP", "SRVPRD", "USTPU", "USWTRADE",
        "USTRADE", "USFIRE", "USGOVT", "ACOGNO", "AMDMNOx", "ANDENOx", "AMDMUOx", "BUSINVx", "M2REAL", "S&P 500", "S&P PE ratio", "TWEXAFEGSMTHx",
        "EXSZUSx", "EXJPUSx", "EXUSUKx", "EXCAUSx",
    ],
    6: [
        "M1SL", "M2SL", "BOGMBASE", "TOTRESNS", "BUSLOANS", "REALLN", "NONREVSL", "WPSFD49207", "WPSFD49502", "WPSID61", "WPSID62", "OILPRICEx",
        "PPICMM", "CPIAUCSL", "CPIAPPSL", "CPITRNSL", "CPIMEDSL", "CUSR0000SAC", "CUSR0000SAD", "CUSR0000SAS", "CPIULFSL", "CUSR0000SA0L2",
        "CUSR0000SA0L5", "PCEPI", "DDURRG3M086SBEA", "DNDGRG3M086SBEA", "DSERRG3M086SBEA", "CES0600000008", "CES2000000008", "CES3000000008",
        "DTCOLNVHFNM", "DTCTHFNM", "INVEST",
    ],
    7: [
        "NONBORRES",
    ],
}

#: Series by group, first taxonomy (8 groups). Fixed values.
EIGHT_GROUPS = {
    "Output and Income": [
        "RPI", "W875RX1", "INDPRO", "IPFPNSS", "IPFINAL", "IPCONGD", "IPDCONGD", "IPNCONGD", "IPBUSEQ", "IPMAT", "IPDMAT", "IPNMAT", "IPMANSICS",
        "IPB51222S", "IPFUELS", "NAPMPI", "CUMFNS",
    ],
    "Labor Market": [
        "HWI", "HWIURATIO", "CLF16OV", "CE16OV", "UNRATE", "UEMPMEAN", "UEMPLT5", "UEMP5TO14", "UEMP15OV", "UEMP15T26", "UEMP27OV", "CLAIMSx",
        "PAYEMS", "USGOOD", "CES1021000001", "USCONS", "MANEMP", "DMANEMP", "NDMANEMP", "SRVPRD", "USTPU", "USWTRADE", "USTRADE", "USFIRE", "USGOVT",
        "CES0600000007", "AWOTMAN", "AWHMAN", "NAPMEI", "CES0600000008", "CES2000000008", "CES3000000008",
    ],
    "Consumption and Orders": [
        "HOUST", "HOUSTNE", "HOUSTMW", "HOUSTS", "HOUSTW", "PERMIT", "PERMITNE", "PERMITMW", "PERMITS", "PERMITW",
    ],
    "Orders and Inventories": [
        "DPCERA3M086SBEA", "CMRMTSPLx", "RETAILx", "NAPM", "NAPMNOI", "NAPMSDI", "NAPMII", "ACOGNO", "AMDMNOx", "ANDENOx", "AMDMUOx", "BUSINVx",
        "ISRATIOx", "UMCSENTx",
    ],
    "Money and Credit": [
        "M1SL", "M2SL", "M2REAL", "AMBSL", "TOTRESNS", "NONBORRES", "BUSLOANS", "REALLN", "NONREVSL", "CONSPI", "MZMSL", "DTCOLNVHFNM", "DTCTHFNM",
        "INVEST", "BOGMBASE",
    ],
    "Interest Rate and Exchange Rates": [
        "FEDFUNDS", "CP3Mx", "TB3MS", "TB6MS", "GS1", "GS5", "GS10", "AAA", "BAA", "COMPAPFFx", "TB3SMFFM", "TB6SMFFM", "T1YFFM", "T5YFFM", "T10YFFM",
        "AAAFFM", "BAAFFM", "TWEXMMTH", "EXSZUSx", "EXJPUSx", "EXUSUKx", "EXCAUSx", "TWEXAFEGSMTHx",
    ],
    "Prices": [
        "PPIIFGS", "PPIFCG", "PPIITM", "PPICRM", "OILPRICEx", "PPICMM", "NAPMPRI", "CPIAUCSL", "CPIAPPSL", "CPITRNSL", "CPIMEDSL", "CUSR0000SAC",
        "CUSR0000SAD", "CUSR0000SAS", "CPIULFSL", "CUUR0000SA0L2", "CUSR0000SA0L5", "PCEPI", "DDURRG3M086SBEA", "DNDGRG3M086SBEA", "DSERRG3M086SBEA",
        "CUSR0000SA0L2", "WPSID61", "WPSID62", "WPSFD49502", "WPSFD49207",
    ],
    "Stock Market": [
        "S&P 500", "S&P: indust", "S&P div yield", "S&P PE ratio", "VIXCLSx",
    ],
}

#: Series by group, second taxonomy (11 groups). Fixed values.
ELEVEN_GROUPS = {
    "Output & Income": [
        "RPI", "W875RX1", "DPCERA3M086SBEA", "CMRMTSPLx", "RETAILx", "INDPRO", "IPFPNSS", "IPFINAL", "IPCONGD", "IPDCONGD", "IPNCONGD", "IPBUSEQ",
        "IPMAT", "IPDMAT", "IPNMAT", "IPMANSICS", "IPB51222S", "IPFUELS", "CUMFNS",
    ],
    "Labor Market": [
        "HWI", "HWIURATIO", "CLF16OV", "CE16OV", "UNRATE", "UEMPMEAN", "UEMPLT5", "UEMP5TO14", "UEMP15OV", "UEMP15T26", "UEMP27OV", "CLAIMSx",
        "PAYEMS", "USGOOD", "CES1021000001", "USCONS", "MANEMP", "DMANEMP", "NDMANEMP", "SRVPRD", "USTPU", "USWTRADE", "USTRADE", "USFIRE", "USGOVT",
        "CES0600000007", "AWOTMAN", "AWHMAN",
    ],
    "Housing": [
        "HOUST", "HOUSTNE", "HOUSTMW", "HOUSTS", "HOUSTW", "PERMIT", "PERMITNE", "PERMITMW", "PERMITS", "PERMITW",
    ],
    "Orders & Inventories": [
        "ACOGNO", "AMDMNOx", "ANDENOx", "AMDMUOx", "BUSINVx", "ISRATIOx",
    ],
    "Money & Credit": [
        "M1SL", "M2SL", "M2REAL", "BOGMBASE", "TOTRESNS", "NONBORRES", "BUSLOANS", "REALLN", "NONREVSL", "CONSPI",
    ],
    "Stock Market": [
        "S&P 500", "S&P div yield", "S&P PE ratio",
    ],
    "Interest & Exchange Rates": [
        "FEDFUNDS", "CP3Mx", "TB3MS", "TB6MS", "GS1", "GS5", "GS10", "AAA", "BAA", "COMPAPFFx", "TB3SMFFM", "TB6SMFFM", "T1YFFM", "T5YFFM", "T10YFFM",
        "AAAFFM", "BAAFFM",
    ],
    "Exchange Rates": [
        "TWEXAFEGSMTHx", "EXSZUSx", "EXJPUSx", "EXUSUKx", "EXCAUSx",
    ],
    "Prices": [
        "WPSFD49207", "WPSFD49502", "WPSID61", "WPSID62", "OILPRICEx", "PPICMM", "CPIAUCSL", "CPIAPPSL", "CPITRNSL", "CPIMEDSL", "CUSR0000SAC",
        "CUSR0000SAD", "CUSR0000SAS", "CPIULFSL", "CUSR0000SA0L2", "CUSR0000SA0L5", "PCEPI",
    ],
    "Consumption & Investment": [
        "DDURRG3M086SBEA", "DNDGRG3M086SBEA", "DSERRG3M086SBEA", "CES0600000008", "CES2000000008", "CES3000000008",
    ],
    "Expectations": [
        "UMCSENTx", "DTCOLNVHFNM", "DTCTHFNM", "INVEST", "VIXCLSx",
    ],
}


def flat(table: dict) -> list[tuple]:
    """(series, key) pairs; of a series in two keys the later wins."""
    return list({name: key for key, names in table.items() for name in names}.items())


def code_map() -> dict[str, int]:
    return dict(flat(SERIES_OF_CODE))


def codes(spark: SparkSession, mapping: dict[str, int] | None = None) -> DataFrame:
    """(series, tcode) dimension."""
    return spark.createDataFrame(sorted((mapping or code_map()).items()), "series string, tcode int")


def groups(spark: SparkSession, taxonomy: str = "eight") -> DataFrame:
    """(series, group) dimension; taxonomy is ``eight`` or ``eleven``."""
    tables = {"eight": EIGHT_GROUPS, "eleven": ELEVEN_GROUPS}
    if taxonomy not in tables:
        raise ValueError(f"taxonomy must be one of {sorted(tables)}")
    return spark.createDataFrame(flat(tables[taxonomy]), "series string, group string")
