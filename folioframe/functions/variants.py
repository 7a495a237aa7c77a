"""Reading members of JSON responses that are stored parsed, as VARIANT, so that no read parses text.

The counterpart of `payload` for text. A response is parsed once when it is stored; text that is no JSON, has a name
twice in one object, or exceeds what a VARIANT holds (16 MiB) gives NULL and stays with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.payload import spellings
from folioframe.functions.text import blank_to_null


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def items(doc: Column, name: str) -> Column:
    """The top-level list `name` as an array of variants; NULL where there is no list."""
    return F.try_variant_get(doc, f"$.{name}", "array<variant>")


def length(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


class Members:
    """The members of an object that a reader wants, read from a variant in one pass over its fields.

    Names may differ in case alone. With `zero_is_missing` a number 0 counts as missing, the text "0" does not: the
    variant knows which it is, and is asked only about texts that may be one. Objects and lists count as missing.
    """

    def __init__(self, *names: str, zero_is_missing: bool = False):
        self._zero_is_missing = zero_is_missing
        wanted = list(dict.fromkeys(names))
        # Only names that differ in case alone need others: Spark resolves fields without regard to case.
        self._renamed = len({name.lower() for name in wanted}) < len(wanted)
        self._place = {name: f"m{i}" if self._renamed else name for i, name in enumerate(wanted)}
        self._type = "struct<" + ",".join(f"`{name}`:string" for name in wanted) + ">"
        self._unique = T.StructType([T.StructField(place, T.StringType()) for place in self._place.values()])

    def rows(self, doc: Column, name: str) -> Column:
        """The members of each element of the top-level list `name`, all read in one pass; NULL for one that is no object."""
        found = F.try_variant_get(doc, f"$.{name}", f"array<{self._type}>")
        return F.transform(found, lambda row: row.cast(self._unique)) if self._renamed else found

    def read_all(self, doc: Column, name: str) -> Column:
        """The objects in the top-level list `name`, as an array of structs of the variant `value`, which rebuilds each
        object, and the members read in `row`."""
        read = F.zip_with(items(doc, name), self.rows(doc, name), lambda value, row: F.struct(value.alias("value"), row.alias("row")))
        objects = F.filter(read, lambda entry: entry["row"].isNotNull())
        if not self._zero_is_missing:
            return objects
        # Inside the array: as columns of a projection so many conditions would be more code than one method holds.
        return F.transform(objects, lambda entry: F.struct(entry["value"].alias("value"), F.struct(*[
            self._filled(name, entry["row"][place], entry["value"]).alias(place) for name, place in self._place.items()]).alias("row")))

    def explode(self, df: DataFrame, doc: Column, name: str) -> DataFrame:
        """One row per object in the top-level list `name`, with `_place`, the variant `_value` and its members `_row`."""
        return df.select("*", F.posexplode(self.read_all(doc, name)).alias("_place", "_entry")).withColumns({
            "_value": F.col("_entry.value"), "_row": F.col("_entry.row"),
        }).drop("_entry")

    def _filled(self, name: str, text: Column, value: Column) -> Column:
        zero = (text.startswith("0") | text.startswith("-0")) & (text.try_cast("double") == 0)
        number = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) != "STRING"
        return F.when(~F.coalesce(zero & number, F.lit(False)), blank_to_null(text))

    def get(self, name: str, row: Column | None = None) -> Column:
        """Text of a member, NULL when missing, JSON null or empty."""
        text = (F.col("_row") if row is None else row)[self._place[name]]
        return text if self._zero_is_missing else blank_to_null(text)

    def pick(self, *names: str) -> Column:
        """First filled member, trying each name in its spellings."""
        return F.coalesce(*[self.get(form) for name in names for form in spellings(name)])


def all_spellings(*names: str) -> Members:
    """Members for `pick`, in which a number 0 counts as missing."""
    return Members(*[form for name in names for form in spellings(name)], zero_is_missing=True)
