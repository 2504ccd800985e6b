"""Saving of this library's own models (S6): small state as JSON beside the metadata, the rest as Parquet tables."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        state, tables = self.model.saved_state()
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": state})
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind.restored(metadata["state"], lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        model._resetUid(metadata["uid"])
        return model


class TableModel(MLWritable, MLReadable):
    """A model that gives ``saved_state() -> (JSON state, {name: table})`` and takes it back in ``restored(state, read)``."""

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)
