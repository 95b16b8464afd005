"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Kinds that are types, framework bases, and name prefixes.
TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD")
DATA_BASES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository")
WRITE_PREFIXES = ("save", "delete", "remove", "insert", "update")
READ_PREFIXES = ("find", "get", "read", "exists", "count", "search")
#: Annotation names and the role they give.
ROLE_OF = {
    "RestController": "CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY",
    "Component": "COMPONENT", "Configuration": "CONFIGURATION", "Entity": "ENTITY", "Test": "TEST",
    "ParameterizedTest": "TEST", "SpringBootTest": "TEST", "WebMvcTest": "TEST", "DataJpaTest": "TEST",
}
#: Mapping annotations and their method; the general one is read from its members.
MAPPING_METHOD = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
#: Text limits.
EVIDENCE_CHARS, EXTERNAL_CHARS = 1900, 1400


def raw_type(text: Column) -> Column:
    """A type as written, without type arguments, array marks and package; null gives ''."""
    bare = F.replace(F.regexp_replace(text, "<.*>", ""), F.lit("[]"), F.lit(""))
    return F.coalesce(F.substring_index(bare, ".", -1), F.lit(""))


def arity(signature: Column) -> Column:
    """Parameters of a signature, counted by its commas."""
    inner = signature.substr(F.lit(2), F.length(signature) - 2)
    return F.when(signature.isNull() | (signature == "()"), 0).otherwise(F.size(F.split(inner, ",")))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "HIGH").when(confidence >= 0.70, "INFERRED").otherwise("AMBIGUOUS")


def data_access(callee: Column) -> Column:
    """WRITES_ENTITY or READS_ENTITY by the beginning of a name, else null."""
    low = F.lower(callee)
    return F.when(low.rlike("^(" + "|".join(WRITE_PREFIXES) + ")"), "WRITES_ENTITY").when(low.rlike("^(" + "|".join(READ_PREFIXES) + ")"), "READS_ENTITY")


def truncated(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def symbol_key(path: Column, kind: Column, qualified_name: Column, signature: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, kind, qualified_name, F.coalesce(signature, F.lit(""))).cast("binary"), 256)


def visibility(modifiers: Column) -> Column:
    return F.when(F.array_contains(modifiers, "public"), "PUBLIC").when(F.array_contains(modifiers, "protected"), "PROTECTED").when(F.array_contains(modifiers, "private"), "PRIVATE").otherwise("PACKAGE")


def node_kind(kind: Column, roles: Column) -> Column:
    """The first of the leading roles that is there, else the symbol's kind."""
    out = kind
    for role in ("COMPONENT", "TEST", "ENTITY", "REPOSITORY", "SERVICE", "CONTROLLER"):
        out = F.when(F.array_contains(roles, role), role).otherwise(out)
    return out


def combined_path(controller: Column, method: Column) -> Column:
    joined = F.regexp_replace(F.concat(F.lit("/"), controller, F.lit("/"), method), "/+", "/")
    return F.when((F.length(joined) > 1) & joined.endswith("/"), joined.substr(F.lit(1), F.length(joined) - 1)).otherwise(joined)
