"""Declared schemas of the input and output tables.

Column names follow the source data so results stay comparable:
``RUT_SOCIEDAD`` company id, ``RUT_SOCIO`` owner id, ``PORCENTAJE_CAPITAL`` /
``PORCENTAJE_UTILIDADES`` capital / profit share in percent, ``CONT_RUT``
taxpayer id, ``Valor`` seed score, ``RUT_FAM`` relative id.
"""

from pyspark.sql import types as T

# Fixed column names shared with the source data.
COMPANY = "RUT_SOCIEDAD"
OWNER = "RUT_SOCIO"
CAPITAL = "PORCENTAJE_CAPITAL"
PROFIT = "PORCENTAJE_UTILIDADES"
TAXPAYER = "CONT_RUT"
SEED_VALUE = "Valor"
RELATIVE = "RUT_FAM"
RELATION_TYPE = "TIPO_RELACION"
GROUP_ID = "PARU_RUT_E"
GROUP_LABEL = "COM"
CHECK_COMPANY = "Oscuridad_PJ"
CHECK_OWNER = "Oscuridad_PN"
CHECK = "Comp"

OWNERSHIP = T.StructType(
    [
        T.StructField(COMPANY, T.StringType()),
        T.StructField(OWNER, T.StringType()),
        T.StructField(CAPITAL, T.DoubleType()),
        T.StructField(PROFIT, T.DoubleType()),
    ]
)

SEED = T.StructType(
    [
        T.StructField(TAXPAYER, T.StringType()),
        T.StructField(SEED_VALUE, T.DoubleType()),
    ]
)

FAMILY = T.StructType(
    [
        T.StructField(TAXPAYER, T.StringType()),
        T.StructField(RELATIVE, T.StringType()),
        T.StructField(RELATION_TYPE, T.StringType()),
    ]
)

KNOWN_GROUPS = T.StructType(
    [
        T.StructField(GROUP_ID, T.StringType()),
        T.StructField(GROUP_LABEL, T.StringType()),
    ]
)

# Older family extracts name the relative column differently.
COLUMN_ALIASES = {"CONT_RUT_FAM": RELATIVE}
