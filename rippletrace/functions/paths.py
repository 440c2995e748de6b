"""Column expressions over repository paths: exclusion, role, module, class name. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippletrace.plans import schema as S


def contains_any(path: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (path.contains(p) for p in parts), F.lit(False))


def is_source_file(path: Column) -> Column:
    return path.endswith(".swift")


def is_skipped_tracked(path: Column) -> Column:
    """Vendored or built files in a listing of tracked files. The parts begin with a slash, so top-level folders pass."""
    return contains_any(path, S.SKIPPED_TRACKED)


def is_skipped_walked(path: Column) -> Column:
    return contains_any(path, S.SKIPPED_WALKED)


def is_skipped_indexed(path: Column) -> Column:
    start = reduce(or_, (path.startswith(p) for p in S.SKIPPED_INDEXED_START))
    end = reduce(or_, (path.endswith(p) for p in S.SKIPPED_INDEXED_END))
    return contains_any(path, S.SKIPPED_INDEXED) | start | end


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, or the path itself outside of it."""
    folder = root.rstrip("/") + "/"
    return F.when(path.startswith(folder), F.substring(path, len(folder) + 1, 1_000_000)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def role_of_path(path: Column) -> Column:
    """UITest, Source, SnapshotTest or UnitTest: the first rule that fits."""
    p, s = F.lower(path), F.lower(stem(path))
    in_tests = contains_any(p, ("tests/", "/test/"))
    named_test = s.endswith("test") | s.endswith("tests")
    return (
        F.when(contains_any(p, ("uitest", "ui_test", "e2etest")), "UITest")
        .when(~in_tests & ~named_test, "Source")
        .when(p.contains("snapshot"), "SnapshotTest")
        .otherwise("UnitTest")
    )


def role_of(path: Column, imports: Column) -> Column:
    """The role by path, unless an import of a snapshot library decides."""
    by_import = F.arrays_overlap(F.coalesce(imports, F.array().cast("array<string>")), F.array(*map(F.lit, S.SNAPSHOT_IMPORTS)))
    return F.when(by_import, "SnapshotTest").otherwise(role_of_path(path))


def module_of(path: Column) -> Column:
    """The first folder named like a test target, else what follows a ``Tests`` folder with a file further down, else null."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    target = F.get(F.filter(folders, lambda c: F.lower(c).rlike("tests?$") & ~F.lower(c).isin("tests", "test")), F.lit(0))
    pairs = F.transform(folders, lambda c, i: F.when((c == "Tests") & (i + 2 < F.size(parts)), F.get(parts, i + 1)))
    return F.coalesce(target, F.get(F.filter(pairs, lambda c: c.isNotNull()), F.lit(0)))


def is_test_class(path: Column) -> Column:
    """Whether the file's name ends as a test class does (case counts); other test files end a path but are never reported."""
    return stem(path).rlike("Tests?$")


def kind_of_role(role: Column) -> Column:
    """The test kind of a role; null for sources."""
    return reduce(lambda c, kv: c.when(role == kv[1], kv[0]), list(S.ROLE_OF_KIND.items())[1:], F.when(role == "UnitTest", "Unit"))


def kind_rank(kind: Column) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[1], kv[0]), list(enumerate(S.KINDS))[1:], F.when(kind == S.KINDS[0], 0))
