"""Two-level datasets: member tables named by split and dataset, held as one DataFrame.

The member names are columns, so an operation on all members is one plan, a selection of members
is a filter that prunes partitions, and nothing is looped over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.hashing import hash_key
from packetloom.functions.names import clean_stem, file_stem, local_path, relative_directory
from packetloom.operators import labels, sampling
from packetloom.operators.ranking import numbered, numbered_within
from packetloom.operators.stored import attach, stored
from packetloom.sources.tables import CSV_OPTIONS

# The manifest, and how deep structs are flattened.
MANIFEST = "manifest"
NEXT = "manifest-next"
MANIFEST_SCHEMA = "kind string, splits array<string>, data string"
KIND = "members"

# What one file of a saved member holds at most, about, and the most tasks that write.
ROWS_PER_FILE = 1_000_000

# Rows that one task may hold as a pandas frame.
GROUP_ROWS = 5_000_000
MOST_TASKS = 20_000
MAX_DEPTH = 16

# Standard columns of the supported tasks.
TASKS = {
    "classification": {"x": "pixel_values", "labels": "labels"},
    "pretraining": {"x": "pixel_values"},
}


def flatten_structs(df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Struct fields as columns named ``struct.field``."""
    for _ in range(max_depth):
        if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
            break
        columns: list[Column] = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`")[n].alias(f"{f.name}.{n}") for n in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def _switch(spark: SparkSession, path: str, data: str) -> None:
    """Put the new manifest in place of the old one, then drop the data folders that no manifest names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    at = [jvm.org.apache.hadoop.fs.Path(folder, name) for name in (MANIFEST, NEXT)]
    system.delete(at[0], True)
    if not system.rename(at[1], at[0]):
        raise OSError(f"can't put the new manifest in place below {path}")
    for entry in system.listStatus(folder):
        name = entry.getPath().getName()
        if (name == "data" or name.startswith("data-")) and name != data:
            system.delete(entry.getPath(), True)


class Members:
    """Immutable: every operation returns another ``Members`` or a DataFrame."""

    def __init__(self, df: DataFrame, split: str = "split", dataset: str = "dataset"):
        missing = {split, dataset} - set(df.columns)
        if missing:
            raise TypeError(f"a member table needs the columns {sorted(missing)}")
        self.df, self.split, self.dataset = df, split, dataset

    # construction

    @classmethod
    def of(cls, tables: dict[str, dict[str, DataFrame]]) -> Members:
        """From tables by split and dataset; columns that a table lacks are null."""
        union = None
        for split, members in tables.items():
            for dataset, df in members.items():
                if not isinstance(df, DataFrame):
                    raise TypeError(f"{split}/{dataset} is a {type(df).__name__}, not a DataFrame")
                named = df.withColumns({"split": F.lit(split), "dataset": F.lit(dataset)})
                union = named if union is None else union.unionByName(named, allowMissingColumns=True)
        if union is None:
            raise ValueError("no tables given")
        return cls(union)

    @classmethod
    def _scan(
        cls, spark: SparkSession, root: str, pattern: str, threshold: int, kind: str, schema: T.StructType | str | None, **options: str
    ) -> Members:
        """One scan of all files below ``root``; where a row came from names its member."""
        reader = spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        reader = reader.options(**options)
        df = (reader.schema(schema) if schema else reader).load(root)
        path = local_path(F.col("_metadata.file_path"))
        home = "/" + root.split("://")[-1].strip("/")
        named = df.where(F.col("_metadata.file_size") > threshold).select(
            *[F.col(f"`{c}`").alias(c.replace(".", "_").lstrip("_")) for c in df.columns],
            relative_directory(path, home).alias("split"),
            clean_stem(file_stem(path)).alias("dataset"),
        )
        return cls(named)

    @classmethod
    def from_csv(
        cls, spark: SparkSession, root: str, schema: T.StructType | str, pattern: str = "*.csv", threshold: int = 0
    ) -> Members:
        """CSV files with a header; malformed lines are skipped, files of at most ``threshold`` bytes too.

        The split is the directory below ``root``, the dataset the cleaned file stem.
        """
        return cls._scan(spark, root, pattern, threshold, "csv", schema, **CSV_OPTIONS)

    @classmethod
    def from_json(
        cls, spark: SparkSession, root: str, schema: T.StructType | str, pattern: str = "*.json*", threshold: int = 0
    ) -> Members:
        return cls._scan(spark, root, pattern, threshold, "json", schema)

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        root: str,
        schema: T.StructType | str | None = None,
        columns: list[str] | None = None,
        pattern: str = "*.parquet",
        threshold: int = 0,
    ) -> Members:
        members = cls._scan(spark, root, pattern, threshold, "parquet", schema)
        return members.select_columns(columns) if columns else members

    @classmethod
    def from_text(cls, spark: SparkSession, root: str, pattern: str = "*.txt", threshold: int = 0) -> Members:
        return cls._scan(spark, root, pattern, threshold, "text", None)

    # storage

    def save(self, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Partitioned Parquet with a manifest of the splits and of the folder that holds the data.

        Each save writes a new folder, then the new manifest beside the old one, and then moves it into its
        place; what was there is dropped last. A save that breaks off leaves the earlier dataset as it was. Members
        are counted first: each goes to as many tasks as its rows ask for, which write a file of about ``rows_per_file``
        rows each, never of over twice as many, and small members are not cut up.
        """
        spark, names = self.df.sparkSession, [self.split, self.dataset]
        data = f"data-{uuid.uuid4().hex}"
        counts = self.df.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
        last = F.ceil(F.col("_rows") / rows_per_file) - 1
        files = stored(counts.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k")), "member-files")
        tasks = numbered(files, [F.col(c).asc() for c in [*names, "_k"]], "_task", start=0)
        parts = stored(tasks.groupBy(*names).agg(F.min("_task").alias("_first"), F.count(F.lit(1)).alias("_files")), "member-tasks")
        # By content, so that a task that runs again deals its rows alike; maps can't be hashed.
        content = [F.col(f"`{f.name}`") for f in self.df.schema.fields if "map<" not in f.dataType.simpleString()]
        task = F.col("_first") + F.pmod(F.xxhash64(*content), F.col("_files"))
        n = max(1, min(files.count(), MOST_TASKS))
        spread = attach(self.df, parts, names).repartitionById(n, F.pmod(task, F.lit(n)).cast("int")).drop("_first", "_files")
        spread.write.option("maxRecordsPerFile", 2 * rows_per_file).partitionBy(*names).parquet(f"{path}/{data}")

        splits = parts.select(F.col(self.split).alias("split")).distinct()
        manifest = splits.agg(
            F.lit(KIND).alias("kind"), F.sort_array(F.collect_set("split")).alias("splits"), F.lit(data).alias("data")
        )
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{NEXT}")
        _switch(spark, path, data)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Members:
        from pyspark.errors import AnalysisException

        rows = []
        # Between the two moves of a switch only the new manifest is there.
        for name in (MANIFEST, NEXT):
            try:
                rows = rows or spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{name}").take(1)
            except AnalysisException as error:
                missing = error
        if not rows:
            raise FileNotFoundError(f"no manifest at {path}/{MANIFEST}: not a saved two-level dataset") from missing
        if rows[0]["kind"] != KIND:
            raise FileNotFoundError(f"{path}/{MANIFEST} does not describe a two-level dataset")
        data = f"{path}/{rows[0]['data'] or 'data'}"
        found = spark.read.parquet(data).schema
        names = [T.StructField(n, T.StringType()) for n in ("split", "dataset")]
        schema = T.StructType([f for f in found.fields if f.name not in ("split", "dataset")] + names)
        return cls(spark.read.schema(schema).parquet(data))

    # selection

    def splits(self) -> list[str]:
        """Split names; a handful, read from partition values where the table is stored."""
        return sorted(r[0] for r in self.df.select(self.split).distinct().collect())

    def __getitem__(self, split: str) -> Members:
        if not isinstance(split, str) or split not in self.splits():
            known = self.splits()
            raise KeyError(f"no split {split!r}; choose one of {known}, for example members[{known[0]!r}]")
        return self._with(self.df.where(F.col(self.split) == split))

    def table(self, split: str, dataset: str) -> DataFrame:
        """One member without its name columns."""
        chosen = self.df.where((F.col(self.split) == split) & (F.col(self.dataset) == dataset))
        return chosen.drop(self.split, self.dataset)

    def _with(self, df: DataFrame) -> Members:
        return Members(df, self.split, self.dataset)

    # shape

    @property
    def column_names(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.split, self.dataset)]

    @property
    def num_columns(self) -> int:
        return len(self.column_names)

    def num_rows(self) -> DataFrame:
        return labels.value_counts(self.df, self.split, self.dataset, name="num_rows")

    def shape(self) -> DataFrame:
        return labels.members_shape(self.df, self.split, self.dataset)

    def unique(self, column: str) -> DataFrame:
        return labels.distinct_per_member(self._known(column), column, self.split, self.dataset)

    def __repr__(self) -> str:
        return f"Members(columns={self.column_names})"

    # columns

    def _known(self, *columns: str) -> DataFrame:
        unknown = [c for c in columns if c not in self.df.columns]
        if unknown:
            raise ValueError(f"no column {unknown}; there are {self.column_names}")
        return self.df

    def cast_column(self, column: str, to: str | T.DataType) -> Members:
        return self._with(self._known(column).withColumn(column, F.col(column).cast(to)))

    def cast(self, types: dict[str, str | T.DataType]) -> Members:
        """Cast all columns; the types must name exactly the columns there are."""
        if set(types) != set(self.column_names):
            raise ValueError(f"types must name the columns {self.column_names}")
        return self._with(self.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def remove_columns(self, columns: str | list[str]) -> Members:
        columns = [columns] if isinstance(columns, str) else columns
        return self._with(self._known(*columns).drop(*columns))

    def rename_columns(self, names: dict[str, str]) -> Members:
        taken = set(self.df.columns) - set(names)
        if len(set(names.values())) < len(names) or taken & set(names.values()):
            raise ValueError("a new name is already taken")
        return self._with(self._known(*names).withColumnsRenamed(names))

    def rename_column(self, old: str, new: str) -> Members:
        return self.rename_columns({old: new})

    def select_columns(self, columns: list[str]) -> Members:
        """Restrict what is read; this object keeps all columns."""
        return self._with(self._known(*columns).select(self.split, self.dataset, *columns))

    def flatten(self, max_depth: int = MAX_DEPTH) -> Members:
        return self._with(flatten_structs(self.df, max_depth))

    def encode_classes(self, column: str, include_nulls: bool = False) -> tuple[Members, DataFrame]:
        coded, mapping = labels.encode_classes(self._known(column), column, include_nulls)
        return self._with(coded), mapping

    def align_labels(self, names: DataFrame, target: DataFrame, label_id: str) -> Members:
        return self._with(labels.align_labels(self._known(label_id), names, target, label_id))

    def prepare_for_task(self, task: str | dict[str, str]) -> Members:
        """Only a task's columns, under the task's names."""
        names = TASKS[task] if isinstance(task, str) else task
        return self.select_columns(list(names)).rename_columns({k: v for k, v in names.items() if k != v})

    # rows

    def _indexed(self, order: list[str] | None) -> DataFrame:
        """With ``index``, the place of a row in its member from 0 in the order of the given columns."""
        if order is None:
            return self.df
        if "index" in self.df.columns:
            raise ValueError("the table has a column 'index' of its own; rename it first")
        return numbered_within(self._known(*order), [self.split, self.dataset], [F.col(c).asc() for c in order], "index", start=0)

    def filter(
        self,
        condition: Column | Callable[..., pd.Series],
        with_indices: list[str] | None = None,
        input_columns: list[str] | None = None,
        **kwargs: object,
    ) -> Members:
        """By a column expression, or by a function of a pandas batch that returns a mask.

        A table has no order of its own: ``with_indices`` names the columns that give one, and the condition
        sees ``index``, the place of the row in its member from 0. With ``input_columns`` a function sees these only
        (and ``index``), and only these and what is kept are read.
        """
        source = self._indexed(with_indices)
        if isinstance(condition, Column):
            return self._with(source.where(condition).select(*self.df.columns))
        given = [*(input_columns or self.df.columns), *(["index"] if with_indices is not None else [])]
        self._known(*(input_columns or []))
        names = self.df.columns

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[np.asarray(condition(batch[given], **kwargs), dtype=bool)][names]

        return self._with(source.mapInPandas(keep, self.df.schema))

    def map(
        self,
        function: Callable[..., pd.DataFrame],
        schema: str | T.StructType,
        input_columns: list[str] | None = None,
        remove_columns: list[str] | None = None,
        batch_size: int | None = None,
        drop_last_batch: bool = False,
        with_rank: bool = False,
        with_indices: list[str] | None = None,
        **kwargs: object,
    ) -> Members:
        """Apply a function to pandas batches.

        It gets the input columns (all by default), with ``rank`` the partition number, with ``index`` the place of
        the row in its member, from 0 in the order of the columns that ``with_indices`` names, and returns a frame of new or replaced columns named in ``schema``. If all other columns are removed it
        may return any number of rows, and then gets the rows of one member at a time.
        ``batch_size`` re-cuts Arrow's batches inside a partition, where ``drop_last_batch`` leaves
        out a short one.
        """
        new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._known(*(input_columns or []))
        source = self._indexed(with_indices)
        source = source.withColumn("rank", F.spark_partition_id()) if with_rank else source
        given = [*(input_columns or self.column_names), *(["rank"] if with_rank else [])]
        given += ["index"] if with_indices is not None else []
        removed = set(remove_columns or []) | set(new.names)
        names = [self.split, self.dataset]
        carried = [f for f in self.df.schema.fields if f.name not in removed]
        free = {f.name for f in carried} == set(names)
        out = T.StructType([*carried, *new.fields])

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if batch_size is None:
                yield from batches
                return
            rest: pd.DataFrame | None = None
            for batch in batches:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                while len(rest) >= batch_size:
                    yield rest.iloc[:batch_size].reset_index(drop=True)
                    rest = rest.iloc[batch_size:].reset_index(drop=True)
            if rest is not None and len(rest) and not drop_last_batch:
                yield rest

        def tagged(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for key, rows in batch.groupby(names, sort=False, dropna=False):
                made = function(rows[given].reset_index(drop=True), **kwargs).reset_index(drop=True)
                yield made.assign(**dict(zip(names, key)))[out.names]

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in cut(batches):
                if free:
                    yield from tagged(batch)
                    continue
                made = function(batch[given], **kwargs).reset_index(drop=True)
                if len(made) != len(batch):
                    raise ValueError("the function changed the number of rows while columns are kept")
                kept = batch[[f.name for f in carried]].reset_index(drop=True)
                yield pd.concat([kept, made[new.names]], axis=1)

        return self._with(source.mapInPandas(apply, out))

    def map_members(
        self,
        function: Callable[[pd.DataFrame], pd.DataFrame],
        schema: str | T.StructType,
        by: list[str] | None = None,
        most_rows: int | None = GROUP_ROWS,
    ) -> Members:
        """Apply a function to whole groups: each member, or each ``(member, by)`` group.

        A group is held by one task; name a finer key such as the flow wherever the work allows it. Groups are counted
        first, and one of over ``most_rows`` rows is refused (None: not counted).
        """
        if most_rows is not None:
            group = [self.split, self.dataset, *(by or [])]
            sizes = self.df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most_rows)
            if large := sizes.take(1):
                named = "/".join(str(v) for v in large[0][:-1])
                raise ValueError(f"{named} has {large[0]['_rows']} rows, which one task would have to hold: name a finer key in by")
        new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        keys = [self.split, self.dataset]
        out = T.StructType([self.df.schema[self.split], self.df.schema[self.dataset], *new.fields])

        def apply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            made = function(group).reset_index(drop=True)
            made.insert(0, keys[0], key[0])
            made.insert(1, keys[1], key[1])
            return made[out.names]

        return self._with(self.df.groupBy(*keys, *(by or [])).applyInPandas(apply, out))

    def transform(self, function: Callable[[DataFrame], DataFrame]) -> Members:
        """A lazily applied DataFrame transformation."""
        return self._with(self.df.transform(function))

    def sort(self, column: str, reverse: bool = False, nulls: str = "last") -> Members:
        """Rows in the order of a column inside every member."""
        c = F.col(column)
        order = {
            (False, "last"): c.asc_nulls_last(),
            (False, "first"): c.asc_nulls_first(),
            (True, "last"): c.desc_nulls_last(),
            (True, "first"): c.desc_nulls_first(),
        }[reverse, nulls]
        return self._with(self._known(column).orderBy(self.split, self.dataset, order))

    def shuffle(self, ids: list[str], seed: int | None = None, seeds: dict[str, int] | None = None) -> Members:
        """Rows in random order inside every member, by one seed or by one seed per split."""
        if (seed is None) == (seeds is None):
            raise ValueError("give either seed or seeds")
        chosen = F.lit(seed)
        for name, value in (seeds or {}).items():
            chosen = F.when(F.col(self.split) == name, F.lit(value)).otherwise(chosen)
        return self._with(self.df.withColumn("_h", hash_key(chosen, *ids)).orderBy(self.split, self.dataset, "_h").drop("_h"))

    # collapsing

    def as_paths(self) -> DataFrame:
        """One table per ``split/dataset`` path, named in ``path``."""
        return self.df.select(F.concat_ws("/", self.split, self.dataset).alias("path"), *self.column_names)

    def as_splits(self) -> DataFrame:
        """All tables of a split together."""
        return self.df.drop(self.dataset)

    def with_validation(self, ids: list[str], test_size: float, label: str, source: str = "train", name: str = "test") -> Members:
        """Split off ``name`` from ``source`` only if there is none yet.

        Rows of ``source`` without a label stay there; rows of no split stay as they are.
        """
        if not self.df.where(F.col(self.split) == name).isEmpty():
            return self
        divided = F.col(self.split).eqNullSafe(source) & F.col(label).isNotNull()
        rest = self.df.where(~divided)
        parts = sampling.split_exact(self.df.where(divided), ids, test_size, label)
        cut = parts.withColumn(self.split, F.when(F.col("part") == "test", name).otherwise(F.col(self.split)))
        return self._with(cut.drop("part").unionByName(rest))
