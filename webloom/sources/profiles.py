"""Language profiles as JSON files, one per language: {"freq": {gram: count}, "n_words": [n1, n2, n3], "name": code}.

A file is written gram by gram while its rows pass, so a language of any size needs one gram of memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from webloom.operators.language import MAX_GRAM
from webloom.sources.files import filesystem, qualified

FILE_SCHEMA = "freq map<string, long>, n_words array<long>, name string"
FORMAT = "language_profiles"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """profiles(lang, n, gram, cnt) from profile files; a file may span lines."""
    files = spark.read.schema(FILE_SCHEMA).option("multiLine", "true").json(path)
    cells = files.select(F.col("name").alias("lang"), F.explode("freq").alias("gram", "cnt"))
    return cells.select("lang", F.length("gram").alias("n"), "gram", "cnt")


@dataclass
class Written(WriterCommitMessage):
    """Drafts that a task has written, and the files they become."""

    drafts: list[tuple[str, str]]


class ProfileWriter(DataSourceArrowWriter):
    """Writes the languages of a task one after the other; the rows of a language come together."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str]] = []
        current, sink, totals, first = None, None, [], True

        def close() -> None:
            if sink is not None:
                sink.write(f'}}, "n_words": {json.dumps(totals)}, "name": {json.dumps(current)}}}\n'.encode())
                sink.close()

        for batch in iterator:
            columns = (batch.column(n).to_pylist() for n in ("lang", "n", "gram", "cnt"))
            for lang, n, gram, count in zip(*columns):
                if lang != current or sink is None:
                    close()
                    # A name of its own for each attempt; names with an underscore are not read.
                    draft = f"{self.path}/_{uuid.uuid4().hex}.json"
                    system, place = filesystem(draft)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    sink, current, totals, first = system.open_output_stream(place), lang, [0] * MAX_GRAM, True
                    sink.write(b'{"freq": {')
                    done.append((draft, f"{self.path}/{file_name(lang)}"))
                sink.write(f"{'' if first else ', '}{json.dumps(gram)}: {count}".encode())
                totals[n - 1] += count
                first = False
        close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Replace the files of the languages written; with `overwrite` all others of the folder go."""
        drafts = [draft for message in messages if message for draft in message.drafts]
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            from pyarrow.fs import FileSelector

            kept = {filesystem(draft)[1] for draft, _ in drafts}
            for info in system.get_file_info(FileSelector(folder)):
                if info.is_file and info.path not in kept:
                    system.delete_file(info.path)
        for draft, final in drafts:
            system.move(filesystem(draft)[1], filesystem(final)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for draft, _ in (d for message in messages if message for d in message.drafts):
            system, place = filesystem(draft)
            system.delete_file(place)


def file_name(lang: str) -> str:
    """A name that no character of a language code can spoil."""
    return "".join(c if c.isalnum() and c.isascii() or c in "-_" and i else f"%{ord(c):X}" for i, c in enumerate(lang)) + ".json"


class ProfileFiles(DataSource):
    """The format `language_profiles`, for writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "lang string, n int, gram string, cnt long"

    def writer(self, schema: T.StructType, overwrite: bool) -> ProfileWriter:
        return ProfileWriter(self.options["path"], overwrite)


def write_profiles(profile: DataFrame, path: str) -> None:
    """One file per language, in place of all files of the folder. Rows are sorted on the way, by tasks that spill."""
    spark = profile.sparkSession
    spark.dataSource.register(ProfileFiles)
    rows = profile.select("lang", F.col("n").cast("int").alias("n"), "gram", F.col("cnt").cast("long").alias("cnt"))
    ordered = rows.filter("lang IS NOT NULL").repartition("lang").sortWithinPartitions("lang", "n", "gram")
    ordered.write.format(FORMAT).mode("overwrite").save(qualified(spark, path))
