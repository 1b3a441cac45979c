"""A store: the connection to a folder of tables."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from ..naming import identity, path_name
from . import jdbc
from .files import Files
from .snapshot import FILE_BYTES, KEEP_SECONDS, Snapshots

#: Gateways of the processes that this one was forked from: what goes through them is theirs.
_inherited: list = []
os.register_at_fork(after_in_child=lambda: _inherited.append(SparkContext._gateway))

_hook: list[Callable[[], None] | None] = [None]
INFO_SCHEMA = "table_name string, nrow long, size_total_gb double, size_data_gb double, size_index_gb double"
SETTINGS = ("driver", "server", "port", "db", "schema", "user", "password", "trusted_connection", "sslmode", "role_create_table")


def set_auth_hook(hook: Callable[[], None] | None) -> Callable[[], None] | None:
    """Set what connect() calls after a first failure; None takes it away. Returns the one before."""
    if hook is not None and not callable(hook):
        raise TypeError("the hook must be callable or None")
    before, _hook[0] = _hook[0], hook
    return before


def get_auth_hook() -> Callable[[], None] | None:
    """The hook that is set, or None."""
    return _hook[0]


class Store:
    """A session and a root folder. Making one opens nothing; connect() does, and the session stays its
    owner's: disconnect() never stops it. Versions of tables stay for keep_seconds after they are replaced,
    and tables are laid out in files of about file_bytes. Tables lie in the folder; settings of a database
    server are those of server_tbl() and copy_to_server()."""

    def __init__(self, spark: SparkSession | None = None, root: str = "", schema: str | None = None, keep_seconds: float = KEEP_SECONDS, file_bytes: int = FILE_BYTES, **settings):
        unknown = set(settings) - set(SETTINGS)
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        self.config = {k: settings.get(k) for k in SETTINGS} | {"schema": schema, "root": root}
        self.keep_seconds, self.file_bytes = keep_seconds, file_bytes
        self._spark = spark
        self._files: Files | None = None
        self._pid: int | None = None
        self.parked: list[Files] = []

    # --- state

    def is_connected(self) -> bool:
        """This process opened the store, the session runs and the root can be read."""
        if self._files is None or self._pid != os.getpid():
            return False
        try:
            return self._session().sparkContext._jsc is not None and self._files.exists(self._files.root)
        except Exception:  # a probe: whatever fails means no connection
            return False

    def _session(self) -> SparkSession:
        found = self._spark or SparkSession.getActiveSession()
        if found is None:
            raise RuntimeError("no session")
        if any(g is not None and g is found.sparkContext._gateway for g in _inherited):
            raise RuntimeError("the session belongs to the process that forked this one; make one here")
        return found

    def _park_inherited(self) -> None:
        """A handle of another process is neither used nor closed here, only put aside."""
        if self._pid is not None and self._pid != os.getpid():
            if self._files is not None:
                self.parked.append(self._files)
            self._files = self._pid = None

    def connect_once(self) -> None:
        if self.is_connected():
            return
        try:
            spark = self._session()
            files = Files(spark, self.config["root"])
            files.mkdirs(files.root)
        except Exception as e:
            raise ConnectionError(f"can't open {self.config['root']!r}: {e}") from e
        self._spark, self._files, self._pid = spark, files, os.getpid()

    def connect(self, attempts: int = 2) -> Store:
        """Try so many times; after the first failure the hook is called once; the i-th pause has i
        seconds, and none follows the last try."""
        self._park_inherited()
        last: Exception | None = None
        for i in range(1, attempts + 1):
            try:
                self.connect_once()
                return self
            except ConnectionError as e:
                last = e
            if i == 1 and get_auth_hook() is not None:
                try:
                    get_auth_hook()()
                except Exception as e:  # a hook that fails doesn't end the attempts
                    last = e
            if i != attempts:
                time.sleep(i)
        raise ConnectionError(f"Failed to connect to database after {attempts} attempts") from last

    def disconnect(self) -> None:
        """Close what this process opened; again is harmless."""
        if self._pid == os.getpid():
            self._files = self._pid = None

    @property
    def connection(self) -> Files | None:
        """The handle, or None."""
        return self._files if self._pid == os.getpid() else None

    @property
    def autoconnection(self) -> Files:
        """The handle; connects if needed."""
        if not self.is_connected():
            self.connect()
        return self._files

    @property
    def spark(self) -> SparkSession:
        self.autoconnection  # noqa: B018  opens the store
        return self._spark

    # --- tables

    def folder(self) -> str:
        files = self.autoconnection
        schema = self.config["schema"]
        return f"{files.root}/{path_name(schema)}" if schema else files.root

    def snapshots(self, table: str | tuple[str, ...]) -> Snapshots:
        parts = identity(table)
        name = path_name(table) if isinstance(table, str) else "+".join(map(path_name, parts))
        return Snapshots(self.spark, self.autoconnection, f"{self.folder()}/{name}", self.keep_seconds, self.file_bytes)

    def manifests(self) -> list:
        """The newest manifest of every table, by name."""
        files, top = self.autoconnection, self.folder()
        found = [Snapshots(self.spark, files, f"{top}/{n}").newest() for n in files.names(top)]
        return sorted((m for m in found if m is not None), key=lambda m: ".".join(m.identity))

    def table_info(self) -> DataFrame:
        """table_name, nrow, size_total_gb, size_data_gb, size_index_gb of every table, by name. Rows and
        bytes come from the manifests; an index is the order of the files and takes no room."""
        rows = [(".".join(m.identity), m.rows, m.bytes / 2**30, m.bytes / 2**30, 0.0) for m in self.manifests()]
        return self.spark.createDataFrame(rows, INFO_SCHEMA)

    # --- servers

    def server_tbl(self, table: str, **how) -> DataFrame:
        """A table of the server that the settings name, as a lazy DataFrame (see jdbc.read_server)."""
        return jdbc.read_server(self.spark, self.config, table, **how)

    def copy_to_server(self, df: DataFrame, table: str, **how) -> None:
        """Rows into a table of the server that the settings name (see jdbc.write_server)."""
        jdbc.write_server(df, self.config, table, **how)

    def __repr__(self) -> str:
        state = "connected" if self.is_connected() else "disconnected"
        shown = {k: "*" * len(v) if k == "password" and v else v for k, v in self.config.items() if v is not None}
        return f"<Store {state}: " + ", ".join(f"{k}={v}" for k, v in shown.items()) + ">"


def get_table_names_and_info(store: Store) -> DataFrame:
    """The catalogue of a store."""
    return store.table_info()
