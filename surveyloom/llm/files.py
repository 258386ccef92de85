"""Files below the shared folder, written and read by tasks in streams.

The folder is the session's checkpoint folder as a full URI, so local disks, HDFS and object stores work alike. A task
writes under a name of its own and reports it in its output row; rows of failed attempts never reach the stored
manifest, so neither do their files.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import SparkSession

from surveyloom.session import fresh_path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The full URI of a folder that nothing has used before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, name))
    uri = path.getFileSystem(conf).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def unique_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def create(uri: str) -> pa.NativeFile:
    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def stream(uri: str) -> pa.NativeFile:
    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_stream(path)


def seekable(uri: str) -> pa.NativeFile:
    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_file(path)
