"""Reading fields of JSON responses held as text.

Lists inside a response are taken as arrays of JSON texts, so that one odd element cannot spoil its list and the
raw object stays at hand. Each object is then parsed once, by the JVM's streaming parser, into a struct of just
the members asked for. Wrong shapes (an object where a list belongs, a bare string among the objects of a list)
give NULL or no row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import blank_to_null

_TEXTS = T.ArrayType(T.StringType())
# A member whose value is the number 0: first ones of an object with the comma after them, others with the one before.
_MAYBE_ZERO = r":\s*-?0[0.eE+-]*\s*[,}]"
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ZERO = _TEXT + r"\s*:\s*-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?"
_ZERO_MEMBERS = rf"(\{{)(?:\s*{_ZERO}\s*(?:,|(?=\}})))+|,\s*{_ZERO}(?=\s*[,}}])|({_TEXT})"
_MAP = T.MapType(T.StringType(), T.StringType())


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated a single time, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(doc: Column, lists: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> Column:
    """Struct of top-level members: lists as arrays of JSON texts, objects as maps of text."""
    fields = [T.StructField(name, _TEXTS) for name in lists] + [T.StructField(name, _MAP) for name in maps]
    return F.from_json(doc, T.StructType(fields))


def items(doc: Column, name: str) -> Column:
    """The top-level list `name` as an array of JSON texts."""
    return parts(doc, lists=(name,))[name]


def first_list(doc: Column, *names: str) -> Column:
    """The first of the top-level lists that has elements."""
    return once(parts(doc, lists=names), lambda found: F.coalesce(*[
        F.when(F.size(found[name]) > 0, found[name]) for name in names
    ]))


def members(doc: Column) -> Column:
    """A JSON object as a map of member texts; NULL for anything else."""
    return F.from_json(doc, _MAP)


def is_object(value: Column) -> Column:
    """Whether a variant is an object."""
    return F.schema_of_variant(value).startswith("OBJECT")


def without_zeros(text: Column) -> Column:
    """A JSON object's text without the members whose value is the number 0; texts like "0" stay.

    Texts are matched whole, so nothing inside one is taken for a member. Most objects hold no such number and are
    left as they are after one test.
    """
    return F.when(text.rlike(_MAYBE_ZERO), F.regexp_replace(text, _ZERO_MEMBERS, "$1$2")).otherwise(text)


def length(array: Column) -> Column:
    """Size of an array, 0 for NULL."""
    return F.when(array.isNull(), 0).otherwise(F.size(array))


def objects(texts: Column) -> Column:
    return F.filter(texts, lambda text: text.startswith("{"))


def spellings(name: str) -> tuple[str, ...]:
    """A member name as given, in lower case and in upper case."""
    return tuple(dict.fromkeys((name, name.lower(), name.upper())))


class Members:
    """The members of a JSON object that a reader wants, and access to them once parsed.

    Names may differ in case alone. Those in `typed` keep the JSON type of their value, for `nonzero`. With
    `zero_is_missing` a JSON number 0 counts as missing in all members, while the text "0" does not.
    """

    def __init__(self, *names: str, typed: tuple[str, ...] = (), zero_is_missing: bool = False):
        self._zero_is_missing = zero_is_missing
        wanted = dict.fromkeys((*names, *typed))
        self._place = {name: f"m{i}" for i, name in enumerate(wanted)}
        kinds = {name: T.VariantType() if name in typed else T.StringType() for name in wanted}
        self._schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
        self._unique = T.StructType([T.StructField(self._place[name], kind) for name, kind in kinds.items()])

    def parse(self, text: Column) -> Column:
        # Spark resolves struct fields without regard to case; the cast gives each a name of its own.
        source = without_zeros(text) if self._zero_is_missing else text
        return F.from_json(source, self._schema).cast(self._unique)

    def parse_all(self, texts: Column) -> Column:
        """The objects among the texts, as an array of structs of the raw `text` and the parsed `row`."""
        return F.transform(objects(texts), lambda text: F.struct(text.alias("text"), self.parse(text).alias("row")))

    def explode(self, df: DataFrame, texts: Column) -> DataFrame:
        """One row per object among the texts, with `_place`, its raw `_text` and the parsed `_row`.

        Objects are parsed before the explode: a filter on a member then tests the parsed row, where one on a
        later projection would be pushed below the parsing and parse again.
        """
        return self.explode_parsed(df, self.parse_all(texts))

    def explode_parsed(self, df: DataFrame, parsed: Column) -> DataFrame:
        """The same from what `parse_all` gave."""
        return df.select("*", F.posexplode(parsed).alias("_place", "_entry")).withColumns({
            "_text": F.col("_entry.text"), "_row": F.col("_entry.row"),
        }).drop("_entry")

    def get(self, name: str, row: Column | None = None) -> Column:
        """Text of a member, NULL when missing, JSON null or empty."""
        return blank_to_null((F.col("_row") if row is None else row)[self._place[name]])

    def pick(self, *names: str, row: Column | None = None) -> Column:
        """First filled member, trying each name in its spellings."""
        return F.coalesce(*[self.get(form, row) for name in names for form in spellings(name)])

    def nonzero(self, name: str, row: Column | None = None) -> Column:
        """Text of a typed member, but a JSON number 0 counts as missing while the text "0" does not."""
        value = (F.col("_row") if row is None else row)[self._place[name]]
        text = value.try_cast("string")
        number_zero = text.isin("0", "0.0", "-0.0") & (F.schema_of_variant(value) != "STRING")
        return F.when(~number_zero, blank_to_null(text))


def all_spellings(*names: str) -> Members:
    """Members for `pick`, in which a number 0 counts as missing."""
    return Members(*[form for name in names for form in spellings(name)], zero_is_missing=True)
