"""Translation of headers and values, station metadata, production tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .contracts import Expectations, checked_join, require_columns, require_rows, require_unique

# Headers of source tables, in capitals and as words, and their standard names.
COLUMN_NAMES = {
    "SAFRA": "season", "Safra": "season", "ESTADO": "state", "Estado": "state", "MUNICÍPIO": "municipality", "Município": "municipality",
    "REGIÃO": "region", "Região": "region", "DATA": "date", "Data": "date", "QUINZENA": "fortnight", "Quinzena": "fortnight",
    "MATÉRIA-PRIMA": "feedstock", "Matéria-prima": "feedstock", "TIPO DE PRODUTO": "product_type", "Tipo de produto": "product_type",
    "MOAGEM": "crush_tonnes", "Moagem": "crush_tonnes", "AÇÚCAR": "sugar_tonnes", "Açúcar": "sugar_tonnes", "PRODUÇÃO": "production", "Produção": "production",
    "ETANOL ANIDRO": "anhydrous_ethanol_m3", "Etanol anidro": "anhydrous_ethanol_m3", "ETANOL HIDRATADO": "hydrous_ethanol_m3", "Etanol hidratado": "hydrous_ethanol_m3",
    "ETANOL TOTAL": "total_ethanol_m3", "Etanol total": "total_ethanol_m3", "ÁREA CULTIVADA": "cultivated_area_ha", "Área cultivada": "cultivated_area_ha",
    "ÁREA COLHIDA": "harvested_area_ha", "Área colhida": "harvested_area_ha", "ÁREA DE VIVEIROS": "nursery_area_ha", "Área de viveiros": "nursery_area_ha",
    "ÁREA EM REFORMA": "renewal_area_ha", "Área em reforma": "renewal_area_ha", "PRODUTIVIDADE": "yield_tonnes_per_ha", "Produtividade": "yield_tonnes_per_ha",
    "ATR": "atr_kg_per_tonne", "ATR MÉDIO": "average_atr_kg_per_tonne", "ATR médio": "average_atr_kg_per_tonne", "VENDAS": "sales", "Vendas": "sales",
    "EXPORTAÇÃO": "exports", "Exportação": "exports", "SÃO PAULO": "sao_paulo", "CENTRO-SUL": "centre_south", "DEMAIS ESTADOS": "other_states",
    "VAR. (%)": "percentage_change", "Var. (%)": "percentage_change",
}
# Names in value columns.
FEEDSTOCKS = {"CANA-DE-AÇÚCAR": "sugarcane", "Cana-de-açúcar": "sugarcane", "CANA DE AÇÚCAR": "sugarcane", "MILHO": "corn", "Milho": "corn"}
PRODUCTS = {
    "AÇÚCAR": "sugar", "Açúcar": "sugar", "ETANOL ANIDRO": "anhydrous_ethanol", "Etanol anidro": "anhydrous_ethanol",
    "ETANOL HIDRATADO": "hydrous_ethanol", "Etanol hidratado": "hydrous_ethanol", "ETANOL TOTAL": "total_ethanol", "Etanol total": "total_ethanol",
}
STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPÁ": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARÁ": "CE", "DISTRITO FEDERAL": "DF", "ESPÍRITO SANTO": "ES", "GOIÁS": "GO",
    "MARANHÃO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG", "PARÁ": "PA", "PARAÍBA": "PB", "PARANÁ": "PR", "PERNAMBUCO": "PE",
    "PIAUÍ": "PI", "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDÔNIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC",
    "SÃO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}
REGIONS = {
    "CENTRO-SUL": "centre_south", "Centro-Sul": "centre_south", "NORTE-NORDESTE": "north_northeast", "Norte-Nordeste": "north_northeast",
    "DEMAIS ESTADOS": "other_states", "Demais Estados": "other_states", "SÃO PAULO": "sao_paulo", "São Paulo": "sao_paulo",
}
VALUE_NAMES = {"feedstock": FEEDSTOCKS, "product_type": PRODUCTS, "state": STATES, "region": REGIONS}
# Headers of the two period tables.
CRUSH_COLUMNS = {"SAFRA": "season", "QUINZENA": "period_end_date", "REGIÃO": "region", "MOAGEM": "crush_tonnes"}
SUGAR_COLUMNS = {"SAFRA": "season", "QUINZENA": "period_end_date", "REGIÃO": "region", "PRODUÇÃO": "sugar_tonnes"}
PERIOD_REGIONS = {"SÃO PAULO": "sao_paulo", "DEMAIS ESTADOS": "other_states"}


def translate(df: DataFrame) -> DataFrame:
    """Standard names of columns and of values in the known value columns."""
    names = [COLUMN_NAMES.get(c, c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"Several columns translate to {twice}.")
    out = df.toDF(*names)
    return out.withColumns({c: text.mapped(text.strip(F.col(c).cast("string")), table) for c, table in VALUE_NAMES.items() if c in names})


def period_table(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A raw period table (crush or sugar) in standard names and types; bad dates and numbers are null."""
    require_columns(raw, columns, "Worksheet")
    value = list(columns.values())[-1]
    out = raw.withColumnsRenamed(columns)
    return out.select(
        text.strip(F.col("season").cast("string")).alias("season"),
        F.col("period_end_date").try_cast("date").alias("period_end_date"),
        text.mapped(text.strip(F.col("region").cast("string")), PERIOD_REGIONS).alias("region"),
        F.col(value).try_cast("double").alias(value),
    )


def check_period_table(df: DataFrame, value: str) -> DataFrame:
    from .contracts import require_exact_columns, require_non_negative, require_values

    require_exact_columns(df, ["season", "period_end_date", "region", value])
    Expectations(df).present(df.columns).check()
    require_values(df, "region", PERIOD_REGIONS.values())
    require_non_negative(df, value)
    return require_unique(df, ["season", "period_end_date", "region"])


def station_metadata(production: DataFrame, places: DataFrame, state_code: int = 35, state: str = "SP", fixes: dict[str, str] | None = None) -> DataFrame:
    """Code and coordinates of every municipality of the production table; a missing one is an error."""
    require_columns(production, ["municipality"], "Production dataset")
    require_columns(places, ["codigo_uf", "nome", "codigo_ibge", "latitude", "longitude"], "Municipality dataset")
    require_rows(production, "Production dataset is empty.")
    cities = production.select("municipality").dropna().distinct().select(text.mapped(F.col("municipality"), fixes).alias("municipality") if fixes else "municipality").withColumn("state", F.lit(state))
    coordinates = places.where(F.col("codigo_uf") == state_code).select(F.col("nome").alias("municipality"), F.col("codigo_ibge").cast("bigint").alias("ibge_code"), "latitude", "longitude").dropDuplicates(["ibge_code"])
    out = checked_join(cities, coordinates, ["municipality"], "left").select("municipality", "state", "ibge_code", "latitude", "longitude")
    Expectations(out).never(F.col("ibge_code").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull(), "Metadata could not be found for these municipalities: ").check()
    return require_unique(out, ["municipality"], "Duplicate municipalities found: ")


def check_metadata(df: DataFrame) -> DataFrame:
    require_columns(df, ["municipality", "state", "ibge_code", "latitude", "longitude"], "Municipality metadata")
    Expectations(df).present(["municipality", "state", "ibge_code", "latitude", "longitude"]).check()
    return require_unique(df, ["ibge_code"])


def state_production(wide: DataFrame, states: Sequence[str], key: str = "Estado/Safra") -> DataFrame:
    """A worksheet with one column by year to one row by state and year."""
    require_columns(wide, [key], "Worksheet")
    rows = wide.withColumnRenamed(key, "state").dropna("all").dropna(subset=["state"]).where(F.col("state").isin(list(states)))
    years = [c for c in rows.columns if c != "state"]
    return rows.unpivot("state", [F.col(f"`{y}`").cast("double").alias(y) for y in years], "harvest_year", "production_thousand_tonnes").dropna(subset=["production_thousand_tonnes"])


def municipal_production(raw: DataFrame, years: Sequence[str], suffix: str = "(SP)") -> DataFrame:
    """Rows of one state of a matrix of municipalities x years, without the suffix."""
    out = raw.toDF("municipality", *years).where(F.col("municipality").endswith(suffix))
    return require_rows(out.withColumn("municipality", text.without_state(F.col("municipality"), f" {suffix}")), "No municipalities of the state were found.")
