"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Boolean words and the text that counts as a number.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
INFERRED_BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "t", "f")
NUMBER_CHARACTERS = "0123456789+-.eE \t\n\r"
INFINITY_WORDS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

# Text read as missing when a file is loaded.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Date and time layouts tried by type inference, most specific first, with the shape of a
# text worth parsing: testing the shape is far cheaper than a failed parse.
_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
DATETIME_SHAPES = {
    "yyyy-MM-dd HH:mm:ss.SSSSSS": rf"^{_DAY} {_TIME}(\.\d{{1,6}})?$",
    "yyyy-MM-dd HH:mm:ss": rf"^{_DAY} {_TIME}$",
    "yyyy-MM-dd'T'HH:mm:ss": rf"^{_DAY}T{_TIME}$",
    "yyyy-MM-dd": rf"^{_DAY}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": rf"^{_DAY}T{_TIME}\.\d{{1,6}}$",
    "yyyy-MM-dd'T'HH:mm:ssXXX": rf"^{_DAY}T{_TIME}(Z|[+-]\d{{2}}:\d{{2}})$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX": rf"^{_DAY}T{_TIME}\.\d{{6}}(Z|[+-]\d{{2}}:\d{{2}})$",
    "yyyy-MM-dd HH:mm": rf"^{_DAY} \d{{2}}:\d{{2}}$",
    "yyyy-MM-dd'T'HH:mm": rf"^{_DAY}T\d{{2}}:\d{{2}}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,9} \d{4}$",
    "dd-MMM-yyyy": r"^\d{2}-[A-Za-z]{3}-\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$",
}
DATETIME_FORMATS = tuple(DATETIME_SHAPES)
_ANY_SHAPE = r"^(?:\d{2,4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}[ -][A-Za-z]{3,9}[ -]\d{4}$|[A-Za-z]{3,9} \d{1,2}, \d{4}$)"


def quoted(name: str) -> str:
    """A column's exact name for an expression, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_double(column: Column) -> Column:
    """Double with NaN read as missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def known(df: DataFrame, name: str) -> Column:
    """A column in its own type, with NaN read as missing."""
    column = ref(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def strip(column: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def title_case(column: Column) -> Column:
    """Capitalise the first letter of every run of letters and lower the others."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def text_to_number(column: Column) -> Column:
    """Number in a text, else null.

    Only texts of number characters reach the parser: it would also take ``1d`` and hex
    numbers, and a failed parse costs far more than the test.
    """
    plain = F.translate(column, NUMBER_CHARACTERS, "") == ""
    infinite = F.lower(F.trim(column)).isin(*INFINITY_WORDS)
    return F.when(plain | infinite, F.trim(column).try_cast("double"))


def text_to_boolean(column: Column) -> Column:
    word = F.lower(strip(column))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def maybe_datetime(column: Column) -> Column:
    """Whether a text starts like a date in any of the known layouts."""
    return F.octet_length(column).between(10, 33) & column.rlike(_ANY_SHAPE)


def text_to_datetime(column: Column, layout: str | None = None) -> Column:
    """Timestamp without zone in a text, else null; without a layout, the first that fits."""
    if layout is None:
        return F.when(maybe_datetime(column), F.coalesce(*[text_to_datetime(column, f) for f in DATETIME_FORMATS]))
    shape = DATETIME_SHAPES.get(layout)
    if shape is not None and layout.endswith("XXX"):
        # A text with a zone names an instant: it is given in UTC.
        instant = F.try_to_timestamp(column, F.lit(layout)).cast("timestamp_ntz")
        return F.when(column.rlike(shape), F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant))
    if shape is not None and layout.startswith("yyyy-MM-dd"):
        return F.when(column.rlike(shape), column.try_cast("timestamp_ntz"))
    parsed = F.try_to_timestamp(column, F.lit(layout)).cast("timestamp_ntz")
    return parsed if shape is None else F.when(column.rlike(shape), parsed)


def sortable_number(name: str, data_type: T.DataType) -> Column:
    """A number that sorts like the column (numbers, dates and timestamps)."""
    column = ref(name)
    if is_numeric(data_type):
        return column.cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        origin = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", origin, column).cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    raise TypeError(f"order column {name} must be a number, date or timestamp, not {data_type}")


def finite(column: Column) -> Column:
    """Double, with NaN and the infinities read as missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
