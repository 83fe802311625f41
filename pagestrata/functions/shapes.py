"""Shapes of untrusted JSON as Column expressions: which fields of an object break their rule.

Text is parsed once, as a variant, so that a field's own type is seen and nothing is cast on the way: "5" is no number.
Defined cases: text that is null, no JSON, no object or names a key twice breaks the rule "" of the object itself; JSON null and an
absent field are two things; unknown fields are ignored; lengths count units of UTF-16; 3.0 is a whole number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = 2**53 - 1
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def utf16_length(text: Column) -> Column:
    """The length in units of UTF-16, in which the limits of requests are stated."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


@dataclass(frozen=True)
class Field:
    """The rule of one field: its kind (text, number, whole, boolean, list, texts, object or choices, an object whose values are choices).

    null and absent say whether the field may be so; low and high bound numbers, text lengths from low to
    high; most bounds the length of a list, longest its texts; choices are all values that a text may have.
    """

    kind: str
    null: bool = False
    absent: bool = False
    low: float | None = None
    high: float | None = None
    most: int | None = None
    longest: int | None = None
    choices: tuple[str, ...] = ()
    pattern: str | None = None

    def broken(self, value: Column, of: Column) -> Column:
        """Whether value (a variant) of the type named of breaks the rule; of is null where the field is absent."""
        wrong = F.coalesce(~self._fits(value, of), F.lit(True))
        return F.when(of.isNull(), not self.absent).when(of == "VOID", not self.null).otherwise(wrong)

    def _fits(self, value: Column, of: Column) -> Column:
        as_type = lambda t: F.try_variant_get(value, "$", t)
        if self.kind in ("number", "whole"):
            n = as_type("double")
            whole = (n == F.floor(n)) & F.abs(n).between(0, WHOLE) if self.kind == "whole" else F.lit(True)
            return of.rlike(NUMBERS) & whole & self._within(n)
        if self.kind == "text":
            text = as_type("string")
            ok = (of == "STRING") & self._within(utf16_length(text))
            if self.choices:
                ok = ok & text.isin(*self.choices)
            return ok & text.rlike(self.pattern) if self.pattern else ok
        if self.kind == "boolean":
            return of == "BOOLEAN"
        if self.kind == "list":
            return of.startswith("ARRAY")
        if self.kind == "texts":
            texts = as_type("array<variant>")
            each = F.forall(texts, lambda v: (F.schema_of_variant(v) == "STRING") & (utf16_length(F.try_variant_get(v, "$", "string")) <= (self.longest or WHOLE)))
            return of.startswith("ARRAY") & each & (F.size(texts) <= (self.most or WHOLE))
        if self.kind == "choices":
            held = F.map_values(as_type("map<string,variant>"))
            return of.startswith("OBJECT") & F.forall(held, lambda v: (F.schema_of_variant(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*self.choices))
        return of.startswith("OBJECT")

    def _within(self, n: Column) -> Column:
        above = F.lit(True) if self.low is None else n >= self.low
        return above if self.high is None else above & (n <= self.high)


def faults(json: Column, shape: Mapping[str, Field]) -> Column:
    """The names of the fields of a JSON text that break the shape, in the shape's order; [""] where the text is no object."""

    def of_object(parsed: Column) -> Column:
        def one(name: str, field: Field) -> Column:
            value = F.try_variant_get(parsed, f"$.{name}", "variant")
            return F.when(field.broken(value, F.schema_of_variant(value)), F.lit(name))

        each = F.filter(F.array(*[one(n, f) for n, f in shape.items()]), lambda n: n.isNotNull())
        return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), each).otherwise(F.array(F.lit("")))

    # a lambda's variable is computed once, however often the rules name it
    return F.get(F.transform(F.array(F.try_parse_json(json)), of_object), F.lit(0))
