"""JSON held as VARIANT: presence tests, typed members and JSON-Schema checks as expressions."""

from pyspark.sql import Column, functions as F

from caretide import settings as S


def only_objects(text: Column, parsed: Column) -> Column:
    """``parsed`` where the JSON in ``text`` is an object, else NULL. Looks at the first character only;
    describing the schema of a whole document to learn its kind would cost more than parsing it."""
    return F.when(text.rlike(r"^\s*\{"), parsed)


def parse_object(text: Column) -> Column:
    """The JSON object in ``text``; NULL for bad JSON and for anything but an object."""
    return only_objects(text, F.try_parse_json(text))


def member(obj: Column, name: str) -> Column:
    """NULL when the key is absent, a VARIANT null when it is present with null."""
    return F.try_variant_get(obj, f"$.{name}", "variant")


def present(obj: Column, name: str) -> Column:
    return member(obj, name).isNotNull()


def get(obj: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(obj, f"$.{path}", kind)


def get_or(obj: Column, name: str, kind: str, default: Column) -> Column:
    """Default only for an absent key; an explicit null stays null."""
    return F.when(present(obj, name), get(obj, name, kind)).otherwise(default)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def number_member(obj: Column, name: str) -> Column:
    """A JSON number as double; strings and booleans are not numbers."""
    return F.when(is_number(kind_of(member(obj, name))), get(obj, name, "double"))


def boolean_member(obj: Column, name: str) -> Column:
    return F.when(kind_of(member(obj, name)) == "BOOLEAN", get(obj, name, "boolean"))


def string_member(obj: Column, name: str) -> Column:
    return F.when(kind_of(member(obj, name)) == "STRING", get(obj, name, "string"))


# --- JSON Schema -> expression ---------------------------------------------

_KINDS = {
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "string": "STRING",
    "boolean": "BOOLEAN",
    "number": "(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)",
    "null": "VOID",
}


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _is(kind: Column, *names: str) -> Column:
    return kind.rlike("^(?:" + "|".join(_KINDS[n] for n in names) + ")$")


def _rules(root: Column, at: str, schema: dict, label: Column) -> list[tuple[bool, Column]]:
    """(is_list, errors) in schema order; ``at`` is the member's path from ``root``.

    An absent member has no kind, so its rules yield nothing without further guards.
    """
    value = F.try_variant_get(root, at, "variant")
    kind = kind_of(value)

    def error(broken: Column, text: str) -> tuple[bool, Column]:
        return False, F.when(broken, F.concat(label, F.lit(text)))

    def typed(name: str) -> Column:
        return F.try_variant_get(root, at, name)

    found: list[tuple[bool, Column]] = []
    for keyword, arg in schema.items():
        if keyword == "type" and (arg, "required" in schema) == ("object", True):
            continue  # told together with the required members: one look at the kind for both
        elif keyword == "type":
            found.append(error(~_is(kind, *(arg if isinstance(arg, list) else [arg])), " type"))
        elif keyword == "required":
            absent = [
                F.when(F.try_variant_get(root, f"{at}.{n}", "variant").isNull(), F.concat(label, F.lit(f" required:{n}")))
                for n in arg
            ]
            members = F.when(kind.startswith("OBJECT"), F.array_compact(F.array(*absent)))
            if schema.get("type") == "object":
                members = members.when(kind.isNotNull(), F.array(F.concat(label, F.lit(" type"))))
            found.append((True, members))
        elif keyword == "enum":
            known = F.coalesce((kind == "STRING") & typed("string").isin(arg), F.lit(False))
            found.append(error(kind.isNotNull() & ~known, " enum"))
        elif keyword == "minimum":
            found.append(error((typed("double") < arg) & _is(kind, "number"), " minimum"))
        elif keyword == "maximum":
            found.append(error((typed("double") > arg) & _is(kind, "number"), " maximum"))
        elif keyword == "minLength":
            found.append(error((F.char_length(typed("string")) < arg) & (kind == "STRING"), " minLength"))
        elif keyword == "items":
            found.append((True, F.flatten(F.transform(typed("array<variant>"), _item_errors(arg, label)))))
        elif keyword == "properties":
            for name, sub in arg.items():
                found += _rules(root, f"{at}.{name}", sub, F.concat(label, F.lit(f".{name}")))
    return found


def _item_errors(schema: dict, label: Column):
    return lambda item, index: schema_errors(item, schema, F.concat(label, F.lit("."), index.cast("string")))


def schema_errors(value: Column, schema: dict, label: Column | None = None) -> Column:
    """Every violation as ``<path> <rule>``, in schema order.

    The schema is walked once while the plan is built, so the executors see one plain expression.
    """
    parts, run = [], []
    for is_list, errors in _rules(value, "$", schema, F.lit("") if label is None else label) + [(True, None)]:
        if not is_list:
            run.append(errors)
            continue
        if run:
            parts.append(F.array_compact(F.array(*run)))
            run = []
        if errors is not None:
            parts.append(F.coalesce(errors, _no_errors()))
    return F.concat(*parts)


def node_schema_errors(value: Column, node: Column) -> Column:
    """Errors of one parsed output under the schema of its node (none for unknown nodes)."""
    out = F
    for name, schema in S.NODE_SCHEMAS.items():
        out = out.when(node == name, F.slice(schema_errors(value, schema), 1, S.MAX_SCHEMA_ERRORS))
    return out.otherwise(_no_errors())
