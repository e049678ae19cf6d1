"""Record schemas with physical constraints, their registry, and the validation of records against them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.validators import HUMIDITY, PRESSURE, TEMPERATURE, Limits

# Key, absolute and typical range, largest rate, units, related quantity and rule.
CONSTRAINTS = (
    ("temperature_celsius", -273.15, 5778.0, -80.0, 125.0, 10.0, "kelvin", "celsius", "humidity", "DewPoint"),
    ("pressure_hpa", 0.0, 1100.0, 870.0, 1085.0, 10.0, "pascal", "hectopascal", "altitude", "AltitudePressure"),
    ("humidity_percent", 0.0, 100.0, 0.0, 100.0, 20.0, "ratio", "percent", "temperature", "DewPoint"),
    ("voc_ppb", 0.0, 10000.0, 0.0, 1000.0, 100.0, "ppb", "ppb", None, None),
    ("pm25_ugm3", 0.0, 1000.0, 0.0, 500.0, 50.0, "kg/m3", "ug/m3", None, None),
    ("acoustic_db_spl", 0.0, 194.0, 20.0, 140.0, 50.0, "pascal", "dB_SPL", None, None),
    ("acoustic_frequency_hz", 0.0, 100000.0, 20.0, 20000.0, 10000.0, "hertz", "Hz", None, None),
    ("vibration_g", -100.0, 100.0, -10.0, 10.0, 1000.0, "m/s2", "g", None, None),
    ("emf_electric_vm", 0.0, 30000.0, 0.1, 300.0, 100.0, "V/m", "V/m", None, None),
)
COLUMNS = "constraint_key string, absolute_min double, absolute_max double, typical_min double, typical_max double, max_rate double, si_unit string, display_unit string, cross_sensor string, cross_rule string"
KEY_OF = {"temperature": "temperature_celsius", "pressure": "pressure_hpa", "humidity": "humidity_percent", "voc": "voc_ppb", "vibration": "vibration_g"}
ATTRIBUTE = "constraints"


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONSTRAINTS), COLUMNS)


def key_of(sensor_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KEY_OF.items() for x in pair]), sensor_type)


def report(records: DataFrame) -> DataFrame:
    """Adds ``errors``, ``warnings``, ``info`` (arrays) and ``is_valid`` to records of sensor_id, ts_ms, value, unit and sensor_type.

    A missing field or a value outside the absolute range is an error, outside the typical range a warning; each rule that
    relates to another sensor is named.  The constraints are a table of nine rows and are broadcast.
    """
    table = F.broadcast(constraints(records.sparkSession)).withColumnRenamed("constraint_key", "_key")
    joined = records.withColumn("_k", key_of(F.col("sensor_type"))).join(table, F.col("_k") == F.col("_key"), "left")
    v = F.col("value")
    missing = [F.when(F.col(c).isNull(), F.concat(F.lit("missing field "), F.lit(c))) for c in ("sensor_id", "ts_ms", "value", "unit")]
    physical = F.when(v < F.col("absolute_min"), "below absolute minimum").when(v > F.col("absolute_max"), "above absolute maximum")
    typical = F.when(physical.isNull(), F.when(v < F.col("typical_min"), "below typical minimum").when(v > F.col("typical_max"), "above typical maximum"))
    info = F.when(F.col("cross_rule").isNotNull(), F.concat(F.col("cross_rule"), F.lit(" with "), F.col("cross_sensor")))
    out = joined.withColumns({"errors": F.array_compact(F.array(*missing, physical)), "warnings": F.array_compact(F.array(typical)), "info": F.array_compact(F.array(info))})
    return out.withColumn("is_valid", F.size("errors") == 0).select(*records.columns, "errors", "warnings", "info", "is_valid")


def report_from_status(status: Column) -> Column:
    """The same report, from a validation status."""
    bad = status != "Valid"
    return F.struct(F.array_compact(F.array(F.when(bad, status))).alias("errors"), (~bad).alias("is_valid"))


def embed(schema: T.StructType, field_name: str, values: dict) -> T.StructType:
    """The schema with constraints in the metadata of a field."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, ATTRIBUTE: json.dumps(values)} if f.name == field_name else f.metadata) for f in schema])


def extract(schema: T.StructType, field_name: str) -> dict | None:
    found = schema[field_name].metadata.get(ATTRIBUTE)
    return json.loads(found) if found else None


def limits_from(key: str) -> Limits:
    """A validator from the table; pressure keeps its own."""
    row = next(r for r in CONSTRAINTS if r[0] == key)
    base = {"temperature_celsius": TEMPERATURE, "humidity_percent": HUMIDITY, "pressure_hpa": PRESSURE}.get(key)
    if base is PRESSURE:
        return PRESSURE
    return Limits(base.sensor_type if base else key, row[3], row[4], row[5], base.accuracy if base else 0.0)


_S, _L, _D, _F, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.FloatType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, bool(optional)) for name, kind, *optional in fields])


SENSOR_READING = _struct(
    ("sensor_id", _S), ("timestamp", _L), ("sensor_type", _S), ("value", _D), ("unit", _S), ("quality", _F, 1),
    ("physics_constraints", _struct(("min_value", _D, 1), ("max_value", _D, 1), ("max_rate_change", _D, 1)), 1),
    ("additional_values", T.MapType(_S, _D), 1), ("metadata", T.MapType(_S, _S), 1),
)
DEVICE_STATUS = _struct(
    ("device_id", _S), ("timestamp", _L), ("battery_percent", _F, 1), ("memory_free_kb", _I, 1), ("cpu_usage_percent", _F, 1), ("temperature_celsius", _F, 1),
    ("uptime_seconds", _L), ("error_count", _I), ("sensors", T.ArrayType(_struct(("sensor_id", _S), ("enabled", _B), ("quality", _F), ("last_reading", _L, 1)))),
)
SENSOR_BATCH = _struct(
    ("batch_id", _S), ("device_id", _S), ("timestamp_start", _L), ("timestamp_end", _L), ("count", _I), ("compression", _S), ("readings", T.BinaryType()),
    ("statistics", _struct(("min_value", _D), ("max_value", _D), ("mean_value", _D), ("std_dev", _D, 1)), 1),
)
ALERT = _struct(("alert_id", _S), ("timestamp", _L), ("severity", _S), ("alert_type", _S), ("sensor_id", _S, 1), ("message", _S), ("details", T.MapType(_S, _S)))

_AVRO = {"string": _S, "long": _L, "double": _D, "float": _F, "int": _I, "boolean": _B, "bytes": T.BinaryType()}


def from_avro_json(text: str | dict) -> T.DataType:
    """The type of an Avro schema: records, enums, arrays, maps and unions with null."""
    s = json.loads(text) if isinstance(text, str) and text.lstrip()[:1] in "{[" else text
    if isinstance(s, str):
        return _AVRO[s]
    if isinstance(s, list):
        return from_avro_json(next(x for x in s if x != "null"))
    if s["type"] == "record":
        return T.StructType([T.StructField(f["name"], from_avro_json(f["type"]), isinstance(f["type"], list)) for f in s["fields"]])
    if s["type"] == "enum":
        return _S
    if s["type"] == "array":
        return T.ArrayType(from_avro_json(s["items"]))
    if s["type"] == "map":
        return T.MapType(_S, from_avro_json(s["values"]))
    return from_avro_json(s["type"])


@dataclass
class Entry:
    schema: T.StructType
    deprecated: bool = False
    metadata: dict = field(default_factory=dict)


class Registry:
    """Schemas by name and numeric version; ``name_v2`` is version 2 of name."""

    def __init__(self):
        self.entries: dict[str, dict[int, Entry]] = {}

    def register(self, name: str, schema: T.StructType, **metadata) -> tuple[str, int]:
        found = re.fullmatch(r"(.+)_v(\d+)", name)
        base, version = (found[1], int(found[2])) if found else (name, 1)
        versions = self.entries.setdefault(base, {})
        if version in versions:
            raise ValueError(f"{base} has a version {version}")
        versions[version] = Entry(schema, metadata=metadata)
        return base, version

    def get(self, name: str, version: int | None = None) -> T.StructType:
        versions = self.entries[name]
        return versions[max(versions) if version is None else version].schema

    def versions(self, name: str) -> list[int]:
        return sorted(self.entries.get(name, {}))

    def deprecate(self, name: str, version: int) -> None:
        self.entries[name][version].deprecated = True

    def compatible(self, name: str, old: int, new: int) -> bool:
        """Whether data of the old version reads as the new: each new field is an old one of its type, or may be null."""
        before = {f.name: f for f in self.get(name, old)}
        return all(before[f.name].dataType == f.dataType if f.name in before else f.nullable for f in self.get(name, new))

    @classmethod
    def with_defaults(cls) -> Registry:
        out = cls()
        for name, schema in (("sensor_reading_v1", SENSOR_READING), ("device_status_v1", DEVICE_STATUS), ("sensor_batch_v1", SENSOR_BATCH), ("alert_v1", ALERT)):
            out.register(name, schema)
        return out
