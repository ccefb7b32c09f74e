"""Node records in text lines, and the parsers' registry.

A line may hold any number of records. A record starts at the text `node`; then its attributes follow in a fixed order,
each found by its name after a blank, two characters further on its value up to the next quote. Lines without a whole
record give no rows."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id of records whose own can't be read.
BAD_ID = 404


def attribute_pattern(*names: str) -> str:
    """Possessive where a value ends, so that a search never gives back part of one."""
    return "node" + '"?+'.join(rf'.*? {n}.{{2}}([^"]*+)' for n in names)


def record_id(text: Column) -> Column:
    """A 64-bit number, or BAD_ID; blanks around it make it unreadable."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.lit(BAD_ID).cast("bigint"))


class Parser(ABC):
    """Text lines to records. A parser for one record a line returns select(...); for more, a generator such as inline
    or a table function."""

    #: The columns that make the key; id is the record.
    keys: tuple[str, ...] = ()

    @abstractmethod
    def parse(self, lines: DataFrame) -> DataFrame:
        """lines (value string) to the keys and id."""


class _Attributes(Parser):
    names: tuple[str, ...] = ()

    def _records(self, lines: DataFrame) -> DataFrame:
        # the cheap test keeps lines without a whole record, long ones too, from the regular expression
        for name in ("node", *(f" {n}" for n in self.names)):
            lines = lines.where(F.col("value").contains(name))
        pattern = F.lit(attribute_pattern(*self.names))
        found = F.arrays_zip(*(F.regexp_extract_all("value", pattern, F.lit(i + 1)).alias(n) for i, n in enumerate(self.names)))
        return lines.select(F.inline(found))


class PointParser(_Attributes):
    """id, lat and lon: x is the longitude, y the latitude. strict: a coordinate that is no number fails the query;
    permissive: its record is dropped."""

    keys, names = ("x", "y"), ("id", "lat", "lon")

    def __init__(self, mode: str = "strict"):
        if mode not in ("strict", "permissive"):
            raise ValueError(f"mode is strict or permissive, not {mode}")
        self.mode = mode

    def parse(self, lines: DataFrame) -> DataFrame:
        number = (lambda c: F.col(c).cast("double")) if self.mode == "strict" else (lambda c: F.col(c).try_cast("double"))
        out = self._records(lines).select(record_id(F.col("id")).alias("id"), number("lon").alias("x"), number("lat").alias("y"))
        return out if self.mode == "strict" else out.where("x is not null and y is not null")


class StringParser(_Attributes):
    """id and str, in lower case."""

    keys, names = ("str",), ("id", "str")

    def parse(self, lines: DataFrame) -> DataFrame:
        return self._records(lines).select(record_id(F.col("id")).alias("id"), F.lower("str").alias("str"))


class FieldParser(Parser):
    """One record a line: id, x and y, in that order, between separators. Other lines give no rows; an id that can't be
    read is BAD_ID."""

    keys = ("x", "y")

    def __init__(self, separator: str = "\t"):
        self.separator = separator

    def parse(self, lines: DataFrame) -> DataFrame:
        fields = F.split_part(F.col("value"), F.lit(self.separator), F.lit(1)), *(F.split_part(F.col("value"), F.lit(self.separator), F.lit(i)).try_cast("double") for i in (2, 3))
        out = lines.select(record_id(fields[0]).alias("id"), fields[1].alias("x"), fields[2].alias("y"))
        return out.where("x is not null and y is not null")


PARSERS: dict[str, type[Parser]] = {}


def register_parser(name: str, parser: type[Parser]) -> None:
    PARSERS[name] = parser


register_parser("OSM", PointParser)
register_parser("BasicTrie", StringParser)
register_parser("Fields", FieldParser)


def make_parser(name: str, **options) -> Parser:
    if name not in PARSERS:
        raise ValueError(f"no parser {name}; there are {', '.join(PARSERS)}")
    return PARSERS[name](**options)


def read_nodes(spark: SparkSession, path: str, parser: Parser) -> DataFrame:
    return parser.parse(spark.read.text(path))


def point_lines(points: DataFrame) -> DataFrame:
    """Points as lines that PointParser reads back."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    return points.select(F.concat(F.lit("<node id="), quoted("id"), F.lit(" lat="), quoted("y"), F.lit(" lon="), quoted("x"), F.lit("/>")).alias("value"))


def string_lines(words: DataFrame) -> DataFrame:
    return words.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" str="'), F.col("str"), F.lit('"/>')).alias("value"))
