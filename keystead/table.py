"""A declared table: ordered typed columns, a primary key, named indexes and two validators.

Every change goes through the validators and the key rules and is committed as one version, so a failed
write leaves the table as it was; also the reloads that empty the table first are atomic. New rows are
written once, and what is validated, checked and committed is that copy.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.transforms import project, scrub_non_finite
from .functions.validators import Validator, field_contents_blank, field_types_blank
from .naming import identity, index_physical_name, quoted
from .operators import dml
from .sources.snapshot import Manifest, Segment
from .sources.store import Store
from .types import schema_of, with_length, without_length

_FILE = "_file"


class Table:
    """A table of a store. Making one does no I/O; the first use creates the table, and columns that
    differ from the declared ones, in names or order, make it anew and empty."""

    def __init__(self, store: Store, table_name: str | tuple[str, ...], field_types: dict[str, str], keys: list[str] = (), indexes: dict[str, list[str]] | None = None, validator_field_types: Validator = field_types_blank, validator_field_contents: Validator = field_contents_blank, owns_store: bool = False, censors: list = ()):
        self.store, self.table_name, self.owns_store = store, table_name, owns_store
        self.identity = identity(table_name)
        self.name = ".".join(self.identity)
        if not validator_field_types(field_types):
            raise ValueError(f"field_types not validated in {self.name}")
        self.field_types = {k: without_length(v) for k, v in field_types.items()}
        self.field_types_with_length = {k: with_length(v) for k, v in field_types.items()}
        self.keys, self.indexes = list(keys), {k: list(v) for k, v in (indexes or {}).items()}
        self.validator_field_contents = validator_field_contents
        self.censors = list(censors)
        self._created = False
        self._adding = False

    # --- lifecycle

    @property
    def schema(self):
        return schema_of(self.field_types)

    def _snapshots(self):
        return self.store.snapshots(self.table_name)

    def connect(self) -> Table:
        """Connect, and create the table if needed."""
        self.store.connect()
        self._ensure()
        return self

    def disconnect(self) -> None:
        """Close the store if the table owns it."""
        if self.owns_store:
            self.store.disconnect()

    def _newest(self) -> Manifest:
        found = self._snapshots().newest()
        if found is None:
            raise LookupError(f"no table {self.name}")
        return found

    def table_exists(self) -> bool:
        return self._snapshots().newest() is not None

    def check_fields_match(self) -> bool:
        """The columns of the stored table are the declared ones, names and order. Prints both if not."""
        live, own = list(self._newest().field_types), list(self.field_types)
        if live != own:
            print(f"fields in {self.name}: {', '.join(live)}\nfields declared: {', '.join(own)}")
        return live == own

    def create_table(self) -> None:
        """Create the table unless it is there with the declared columns; with others the next version has
        the declared ones and no rows. Unknown types raise before anything is written."""
        schema_of(self.field_types, self.keys)
        shots = self._snapshots()
        old = shots.newest()
        if old is not None and list(old.field_types) == list(self.field_types):
            self._created = True
            return
        if unknown := [k for k in self.keys if k not in self.field_types]:
            raise ValueError(f"keys that are not fields: {', '.join(unknown)}")
        shots.commit(old, Manifest(0, self.identity, self.field_types, tuple(self.keys)))
        self._created = True
        self.add_indexes()

    def _ensure(self) -> None:
        if not self._created or not self.table_exists():
            self.create_table()

    def remove_table(self) -> None:
        """Drop the table if it is there; the next use creates it again."""
        self._snapshots().remove()
        self._created = False

    # --- reads

    def tbl(self) -> DataFrame:
        """The rows as a lazy DataFrame of the version that is newest now."""
        self._ensure()
        return self._snapshots().read(self._newest(), self.schema)

    def head(self, n: int = 6) -> DataFrame:
        return self.tbl().limit(n)

    def nrow(self, use_count: bool = False) -> int:
        """Rows: counted, or as the manifest says."""
        self._ensure()
        return self.tbl().count() if use_count else self._newest().rows

    def info(self) -> DataFrame:
        """This table's row of the catalogue."""
        return self.store.table_info().where(F.col("table_name") == self.name)

    def print_dplyr_select(self) -> str:
        """A template that selects all columns, printed and returned."""
        text = ".select(\n" + ",\n".join(f"    {c!r}" for c in self.field_types) + ",\n)"
        print(text)
        return text

    # --- validation

    def _validate(self, data: DataFrame, exactly: bool = False) -> None:
        said = self.validator_field_contents(data)
        if exactly and not (said is True or getattr(said, "ok", None) is True):
            raise ValueError(f"load_data_infile not validated in {self.name}. {getattr(said, 'var', None) or 'not named by the validator'}")
        if not said:
            raise ValueError(f"load_data_infile not validated in {self.name}. {getattr(said, 'var', None)}")

    def _frame(self, newdata) -> DataFrame | None:
        """newdata as a DataFrame: one, a pandas frame, or a list of rows; None stays."""
        if newdata is None or isinstance(newdata, DataFrame):
            data = newdata
        elif hasattr(newdata, "iloc"):
            data = self.store.spark.createDataFrame(newdata) if len(newdata) else self.store.spark.createDataFrame([], self.schema)
        elif isinstance(newdata, (list, tuple)):
            data = self.store.spark.createDataFrame(list(newdata), self.schema)
        else:
            raise TypeError("newdata is not a data frame")
        for censor in self.censors if data is not None else ():
            data = censor(data)
        return data

    def _copy(self, data: DataFrame) -> tuple[Segment | None, DataFrame]:
        """data, all columns, written as it is, and read from there."""
        for f in data.schema.fields:
            if isinstance(f.dataType, T.NullType):
                data = data.withColumn(f.name, F.col(quoted(f.name)).cast("string"))
        shots = self._snapshots()
        raw = shots.stage(data)
        return raw, self.store.spark.read.schema(data.schema).parquet(shots.path(raw)) if raw else self.store.spark.createDataFrame([], data.schema)

    def _stage(self, data: DataFrame, by_range: bool = False) -> Segment | None:
        """Write the declared columns as a segment; None without rows."""
        layout = [c for c in next(iter(self.indexes.values()), self.keys) if c in self.field_types]
        return self._snapshots().stage(scrub_non_finite(project(data, self.schema)), [quoted(c) for c in layout], [k for k in self.keys if k in self.field_types], by_range)

    def _take(self, data: DataFrame, last: list[str | Column] | None = None) -> Segment | None:
        """New rows, validated, as a segment; None without rows, before validation. data is read once: a
        validator, and the choice of the last of equal keys, read a copy with all its columns."""
        if self.validator_field_contents is field_contents_blank and last is None:
            return self._stage(data)
        raw, copy = self._copy(data)
        try:
            if raw is None:
                return None
            self._validate(copy)
            return self._stage(copy if last is None else dml.last_wins(copy, self.keys, last))
        finally:
            self._snapshots().discard(raw)

    def _check_keys(self, rows: DataFrame, base: DataFrame | None) -> None:
        """Keys of rows aren't null, don't repeat, and don't occur in base."""
        if not self.keys:
            return
        if not dml.null_keys(rows, self.keys).isEmpty():
            raise ValueError(f"NOT NULL constraint failed in {self.name}: {', '.join(self.keys)}")
        if not dml.duplicate_keys(rows, self.keys).isEmpty():
            raise ValueError(f"duplicate key in newdata for {self.name}")
        if base is not None and not dml.matched(base, rows, self.keys, "left_semi").isEmpty():
            raise ValueError(f"duplicate key: a row with the same key is in {self.name}")

    # --- writes

    def insert_data(self, newdata, confirm_insert_via_nrow: bool = False, verbose: bool = True) -> None:
        """Append rows. None or no rows return before validation; a key that is null, repeated or there
        already raises. Only the new rows are written, and only files whose range of the first key holds
        one of theirs are read."""
        self._ensure()
        data = self._frame(newdata)
        new = None if data is None else self._take(data)
        if new is None:
            return
        self._insert(new)
        if confirm_insert_via_nrow and self.nrow(True) < new.rows:
            shots = self._snapshots()
            self.upsert_data(shots.read(self._newest(), self.schema, (new,)))
            if self.nrow(True) < new.rows:
                raise RuntimeError("Upsert failed")

    def _insert(self, new: Segment | None, replacing: bool = False) -> None:
        shots, old = self._snapshots(), self._newest()
        try:
            if new is not None and self.keys:
                near = () if replacing else shots.near(old.segments, new, self.schema)
                self._check_keys(shots.read(old, self.schema, (new,)), shots.read(old, self.schema, near) if near else None)
            kept = () if replacing else old.segments
            shots.commit(old, replace(old, segments=kept + ((new,) if new else ())))
        except Exception:
            shots.discard(new)
            raise

    def upsert_data(self, newdata, drop_indexes: list[str] | None = None, verbose: bool = True, on_duplicate: str = "raise", order_by: list[str | Column] = ()) -> None:
        """Update rows of equal keys and add the others. None or no rows return before validation.

        Repeated keys in newdata raise, or with on_duplicate="last" the last row by order_by counts. Only
        files that hold a key of newdata are rewritten. drop_indexes and verbose are accepted and have no
        effect."""
        self._ensure()
        data = self._frame(newdata)
        if data is None:
            return
        if on_duplicate not in ("raise", "last"):
            raise ValueError("on_duplicate is raise or last")
        if on_duplicate == "last" and not order_by:
            raise ValueError('on_duplicate="last" needs order_by')
        if on_duplicate == "last":
            self._check_upsert()
        new = self._take(data, list(order_by) if on_duplicate == "last" else None)
        if new is not None:
            self._upsert(new)

    def _check_upsert(self) -> None:
        if not self.keys:
            raise ValueError("keys is empty")
        if missing := [k for k in self.keys if k not in self.field_types]:
            raise ValueError(f"keys that are not fields: {', '.join(missing)}. Missing from fields")
        live, own = set(self._newest().field_types), set(self.field_types)
        if live != own:
            raise ValueError(f"fields don't match {self.name}. Missing from fields: {sorted(live - own)}. In fields but not the table: {sorted(own - live)}. In the table but not fields: {sorted(live - own)}")

    def _upsert(self, new: Segment | None, replacing: bool = False) -> None:
        shots, old = self._snapshots(), self._newest()
        made: list[Segment | None] = [new]
        try:
            self._check_upsert()
            if new is None:
                shots.commit(old, replace(old, segments=()))
                return
            delta = shots.read(old, self.schema, (new,))
            self._check_keys(delta, None)
            segments = () if replacing else old.segments
            near = shots.near(segments, new, self.schema)
            if near and set(self.keys) == set(self.field_types):  # nothing to update: only new keys are added
                added = self._stage(dml.matched(delta, shots.read(old, self.schema, near), self.keys, "left_anti"))
                shots.discard(made.pop())
                made.append(added)
            else:
                touched = self._touched(old, near, lambda df: dml.matched(df, delta, self.keys, "left_semi"))
                if touched:
                    rows = shots.read(old, self.schema, tuple(s.with_files(touched) for s in near))
                    made.append(self._stage(dml.matched(rows, delta, self.keys, "left_anti")))
                    segments = tuple(s.with_files(touched, False) for s in segments)
            shots.commit(old, replace(old, segments=segments + tuple(s for s in made[::-1] if s)))
        except Exception:
            for s in made:
                shots.discard(s)
            raise

    def _touched(self, old: Manifest, segments: tuple[Segment, ...], hit) -> set[str]:
        """Files (folder/file) with a row that hit leaves. Their names come to the driver, which has those
        of all files in the manifest."""
        if not segments:
            return set()
        rows = self._snapshots().read(old, self.schema, segments).withColumn(_FILE, F.col("_metadata.file_path"))
        return {"/".join(r[0].split("/")[-2:]) for r in hit(rows).select(_FILE).distinct().collect()}

    def _rewrite(self, remove, keep) -> None:
        shots, old = self._snapshots(), self._newest()
        touched = self._touched(old, old.segments, remove)
        if not touched:
            return
        rows = shots.read(old, self.schema, tuple(x for s in old.segments if (x := s.with_files(touched)).files))
        new = self._stage(keep(rows))
        try:
            same = tuple(s.with_files(touched, False) for s in old.segments)
            shots.commit(old, replace(old, segments=same + ((new,) if new else ())))
        except Exception:
            shots.discard(new)
            raise

    def drop_rows_where(self, condition: str) -> None:
        """Delete the rows for which the condition is true; false and null stay."""
        self._ensure()
        self._rewrite(lambda df: dml.keep_where(df, condition), lambda df: dml.drop_where(df, condition))

    def keep_rows_where(self, condition: str) -> None:
        """Keep only the rows for which the condition is true; false and null go. Keys and indexes stay."""
        self._ensure()
        self._rewrite(lambda df: dml.drop_where(df, condition), lambda df: dml.keep_where(df, condition))

    def drop_all_rows(self) -> None:
        """Empty the table; it, its keys and indexes stay."""
        self._ensure()
        old = self._newest()
        self._snapshots().commit(old, replace(old, segments=()))

    def _replace_all(self, newdata, method: str, load) -> None:
        """What a reload has to pass before the table is touched, or even created, then the load. The rows
        that newdata counts have to be those that were copied; the copy is what is validated and loaded."""
        if newdata is None:
            raise ValueError(f"{method}: newdata is NULL")
        if not (isinstance(newdata, DataFrame) or hasattr(newdata, "iloc")):
            raise TypeError(f"{method}: newdata is not a data frame")
        data = self._frame(newdata)
        counted = data.count()
        raw, copy = self._copy(data)
        try:
            if counted != (copied := raw.rows if raw else 0):
                raise ValueError(f"{method}: two reads of the row count of newdata differ: {counted} and {copied}")
            self._validate(copy, exactly=True)
            new = self._stage(copy)
        finally:
            self._snapshots().discard(raw)
        self._ensure()
        load(new)

    def drop_all_rows_and_then_upsert_data(self, newdata, drop_indexes: list[str] | None = None, verbose: bool = True) -> None:
        """Replace all rows, in one commit. No rows that validate empty the table."""
        self._replace_all(newdata, "drop_all_rows_and_then_upsert_data", lambda new: self._upsert(new, replacing=True) if new else self.drop_all_rows())

    def drop_all_rows_and_then_insert_data(self, newdata, confirm_insert_via_nrow: bool = False, verbose: bool = True) -> None:
        """Replace all rows, in one commit. No rows that validate empty the table."""
        self._replace_all(newdata, "drop_all_rows_and_then_insert_data", lambda new: self._insert(new, replacing=True))

    def compact(self) -> None:
        """Rewrite all rows as one segment whose files lie apart by key; rows don't change."""
        self._ensure()
        shots, old = self._snapshots(), self._newest()
        if len(old.segments) > 1 or any(s.overlaps() for s in old.segments):
            new = self._stage(shots.read(old, self.schema), by_range=True)
            shots.commit(old, replace(old, segments=(new,) if new else ()))

    def vacuum(self, keep_seconds: float | None = None) -> None:
        """Remove versions that were replaced so long ago, and what failed writers left. Without a number
        it is the store's."""
        self._ensure()
        self._snapshots().vacuum(keep_seconds)

    # --- keys and indexes

    def add_constraint(self, keys: list[str] | None = None) -> None:
        """Make columns the primary key; rows that are there must not break it."""
        self._ensure()
        keys = list(self.keys if keys is None else keys)
        before, self.keys = self.keys, keys
        try:
            self._check_keys(self.tbl(), None)
        except ValueError:
            self.keys = before
            raise
        old = self._newest()
        self._snapshots().commit(old, replace(old, keys=tuple(keys)))

    def drop_constraint(self) -> None:
        """Forget the primary key."""
        old = self._newest()
        self._snapshots().commit(old, replace(old, keys=()))
        self.keys = []

    def index_physical_name(self, index: str) -> str:
        return index_physical_name(self.identity, index)

    def get_indexes(self) -> list[str]:
        """Physical names in order of their making."""
        return list(self._newest().indexes)

    def get_index_columns(self, physical: str) -> list[str] | None:
        """Columns of an index in its order; none if the table has no such index; None if there is no
        table to ask."""
        return list(self._newest().indexes.get(physical, ())) if self.table_exists() else None

    def _add_index(self, index: str) -> None:
        columns, physical = self.indexes[index], self.index_physical_name(index)
        if missing := [c for c in columns if c.lower() not in {x.lower() for x in self.field_types}]:
            raise ValueError(f"no such column: {', '.join(missing)} for index {index}")
        old = self._newest()
        there = old.indexes.get(physical)
        if there is None:
            self._snapshots().commit(old, replace(old, indexes={**old.indexes, physical: tuple(columns)}))
            there = self.get_index_columns(physical)
            if not there:
                raise RuntimeError(f"index {index} ({physical}) is not on table {self.name}")
        if not _same(there, columns):
            raise ValueError(f"index {index} of {self.name} covers {', '.join(there)}, not {', '.join(columns)}")

    def add_indexes(self) -> None:
        """Add every declared index that isn't there. The first one is also the order in which files are
        written, so that its ranges prune reads."""
        if self._adding:
            return
        self._adding = True
        try:
            self._ensure()
            for index in self.indexes:
                self._add_index(index)
        finally:
            self._adding = False

    def drop_indexes(self) -> None:
        """Drop the declared indexes; those of others stay."""
        old = self._newest()
        mine = {self.index_physical_name(x) for x in self.indexes}
        if mine & set(old.indexes):
            self._snapshots().commit(old, replace(old, indexes={k: v for k, v in old.indexes.items() if k not in mine}))

    def confirm_indexes(self) -> None:
        """Add what is missing; equal ones cause no write; other columns raise; foreign ones are left."""
        self._ensure()
        for index in self.indexes:
            self._add_index(index)

    def __repr__(self) -> str:
        state = "connected" if self.store.is_connected() else "disconnected"
        columns = [f"  {i}: {c} {t}{' (KEY)' if c in self.keys else ''}" for i, (c, t) in enumerate(self.field_types.items(), 1)]
        return "\n".join([f"<Table {self.name}, {state}>", *columns])


def _same(a, b) -> bool:
    return [x.lower() for x in a] == [x.lower() for x in b]
