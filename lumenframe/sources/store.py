"""Tables of the array model in a folder: schemas, checked ingest, metadata, build log, scans."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import matches_any, parse_selection

#: The tables and their columns.
SCHEMAS = {
    "axis": "name string, idx long, coord double, keep boolean, weight double",
    "spectra": "s long, flux array<double>",
    "templates": "p long, z int, age int, alpha int, flux array<double>",
    "losvd": "s long, c int, h array<double>",
    "rebin": "kind string, t long, l long, w double",
    "pixels": "pix long, x double, y double, bin int",
    "comp_prior": "c int, w double",
    "models": "tile int, s long, c int, p long, m array<float>",
    "build_log": "tile int, cb int, pb int",
    "column_stats": "c int, p long, energy double, flux_ref double",
    "support": "tile int, c int, amp_ok boolean, energy_ok boolean",
    "solution": "run_id string, epoch int, rmse double, c int, p long, x double",
    "tracker_events": "seq long, ts timestamp, op string, epoch int, value double, done long, total long",
    "metadata": "key string, value string",
}
#: Tables that are laid out by tile, so that a tile's scan opens its own folder only.
BY_TILE = ("models", "build_log", "support")


class Store:
    """A folder of Parquet tables.  Opening reads nothing; a missing table is empty."""

    def __init__(self, spark: SparkSession, path: str, tile_size: int = 128):
        self.spark, self.path, self.tile_size = spark, path.rstrip("/"), tile_size

    def _restore(self, name: str) -> None:
        """Puts back a table whose rewrite was cut off between its two renames."""
        jvm = self.spark.sparkContext._jvm
        here, kept = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}{s}") for s in ("", ".old"))
        fs = here.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(here) and fs.exists(kept):
            fs.rename(kept, here)

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def present(self) -> bool:
        """Whether there is a store at this path: one with metadata."""
        return self._exists("metadata")

    def invalidate(self, tiles: Sequence[int] | None = None) -> None:
        """Takes tiles, or all, out of the build log, so that the next build makes them anew."""
        jvm = self.spark.sparkContext._jvm
        done = [r["tile"] for r in self.table("build_log").select("tile").distinct().collect()]  # thousands at most
        for tile in done if tiles is None else set(done) & set(tiles):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/build_log/tile={tile}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.set_metadata(complete=False)

    def dims(self) -> dict[str, int]:
        """Sizes of the axes: from the metadata, else counted."""
        meta, pops = self.metadata(), None
        if "pop_shape" in meta:
            pops = int(np.prod(meta["pop_shape"]))
        return {
            "s": int(meta["n_s"]) if "n_s" in meta else self.table("spectra").count(),
            "l": int(meta["n_l"]) if "n_l" in meta else len(self.axis("observed")),
            "c": int(meta["n_c"]) if "n_c" in meta else self.table("losvd").select("c").distinct().count(),
            "p": pops if pops is not None else self.table("templates").count(),
        }

    def template(self, p: int) -> DataFrame:
        return self.table("templates").where(F.col("p") == p)

    def histogram(self, s: int, c: int) -> DataFrame:
        return self.table("losvd").where((F.col("s") == s) & (F.col("c") == c))

    def basis(self, s: int, c: int) -> DataFrame:
        """One component's models of one aperture."""
        return self.plane(s).where(F.col("c") == c)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            self._restore(name)
        if not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", codec: str = "zstd") -> None:
        """Writes a table with its declared columns; tiles of a tiled table replace themselves only."""
        kinds = [c.strip().split(" ", 1) for c in SCHEMAS[name].split(",")]
        out = df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds)).write.mode(mode).option("compression", codec)
        if name in BY_TILE:
            out = out.partitionBy("tile").option("partitionOverwriteMode", "dynamic")
        out.parquet(f"{self.path}/{name}")

    def rewrite(self, name: str, codec: str, files: int) -> None:
        """Re-encodes a table beside itself and swaps the folders.

        A failure leaves the old table under its name, or beside it as ``.old`` with the new one under the name missing:
        opening the store then puts it back.
        """
        self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").repartition(files).write.mode("overwrite").option("compression", codec).parquet(f"{self.path}/{name}.new")
        jvm = self.spark.sparkContext._jvm
        old, new, kept = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}{s}") for s in ("", ".new", ".old"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(kept, True)
        fs.rename(old, kept)
        fs.rename(new, old)
        fs.delete(kept, True)

    def metadata(self) -> dict[str, object]:
        """A few entries, the last one of a key."""
        return {r["key"]: json.loads(r["value"]) for r in self.table("metadata").collect()}

    def set_metadata(self, **entries: object) -> None:
        merged = {**self.metadata(), **entries}
        self.write("metadata", self.spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(merged.items())], SCHEMAS["metadata"]).coalesce(1))

    def complete(self) -> bool:
        return bool(self.metadata().get("complete", False))

    def ingest(self, *, spectra: np.ndarray, losvd: np.ndarray, templates: np.ndarray, template_log: Sequence[float], observed_log: Sequence[float], velocities: Sequence[float], mask: Sequence[bool] | None = None, prior: Sequence[float] | None = None, pixels: Mapping[str, Sequence] | None = None) -> None:
        """Arrays into tables: spectra (L, S), losvd (S, V, C), templates (T, Z, A, alpha); checked before anything is written."""
        n_l, n_s = spectra.shape
        if losvd.ndim != 3 or losvd.shape[0] != n_s or losvd.shape[1] != len(velocities):
            raise ValueError("losvd must be (S, V, C)")
        if templates.ndim != 4 or templates.shape[0] != len(template_log) or len(observed_log) != n_l:
            raise ValueError("templates must be (T, Z, A, alpha) and the grids as long as their axes")
        for name, grid in (("template", template_log), ("observed", observed_log), ("velocity", velocities)):
            if not (np.isfinite(grid).all() and (np.diff(grid) > 0).all()):
                raise ValueError(f"the {name} grid must be finite and increase")
        keep = np.ones(n_l, bool) if mask is None else np.asarray(mask, bool)
        if len(keep) != n_l:
            raise ValueError("the mask must be as long as the observed grid")
        if pixels is not None and not all(0 <= b < n_s for b in pixels["bin"]):
            raise ValueError("a pixel's bin must be an aperture")
        if prior is not None:
            total = np.asarray(prior, float).reshape(losvd.shape[2], -1).sum(axis=1)
            prior = total / total.sum() if total.sum() > 0 else np.full(len(total), 1 / len(total))
        axes = [(n, i, float(x), bool(k), 1.0) for n, grid, flags in (("template", template_log, None), ("observed", observed_log, keep), ("velocity", velocities, None)) for i, (x, k) in enumerate(zip(grid, flags if flags is not None else [True] * len(grid), strict=True))]
        frame = lambda rows, name: self.spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMAS[name].split(", ")]), SCHEMAS[name])
        self.write("axis", frame(axes, "axis"))
        self.write("spectra", frame([(s, spectra[:, s].astype(float).tolist()) for s in range(n_s)], "spectra"))
        self.write("losvd", frame([(s, c, losvd[s, :, c].astype(float).tolist()) for s in range(n_s) for c in range(losvd.shape[2])], "losvd"))
        _, n_z, n_age, n_alpha = templates.shape
        self.write("templates", frame([((z * n_age + a) * n_alpha + k, z, a, k, templates[:, z, a, k].astype(float).tolist()) for z in range(n_z) for a in range(n_age) for k in range(n_alpha)], "templates"))
        if prior is not None:
            self.write("comp_prior", frame([(c, float(w)) for c, w in enumerate(prior)], "comp_prior"))
        if pixels is not None:
            self.write("pixels", frame([(i, float(x), float(y), int(b)) for i, (x, y, b) in enumerate(zip(pixels["x"], pixels["y"], pixels["bin"], strict=True))], "pixels"))
        self.set_metadata(n_s=n_s, n_l=n_l, n_t=len(template_log), n_v=len(velocities), n_c=losvd.shape[2], pop_shape=[n_z, n_age, n_alpha], complete=False)

    def ingest_tables(self, *, spectra: DataFrame, losvd: DataFrame, templates: DataFrame, axis: DataFrame, prior: DataFrame | None = None, pixels: DataFrame | None = None, pop_shape: Sequence[int] | None = None) -> None:
        """Tables with the declared columns into the store; checked in Spark before anything is written, and never on the driver.

        Of a prior with a weight for each column the populations are summed; it sums to one, and evenly where it has no mass.
        """
        sizes = {r["name"]: (r["n"], r["bad"]) for r in axis.withColumn("_step", F.col("coord") - F.lag("coord").over(W.partitionBy("name").orderBy("idx"))).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.isnan("coord") | F.col("coord").isNull() | (F.col("_step") <= 0)).alias("bad")).collect()}
        for name in ("template", "observed", "velocity"):
            if name not in sizes or sizes[name][1]:
                raise ValueError(f"the {name} grid must be finite and increase")
        for label, table, column, name in (("spectra", spectra, "flux", "observed"), ("losvd", losvd, "h", "velocity"), ("templates", templates, "flux", "template")):
            if not table.where(F.coalesce(F.size(column) != sizes[name][0], F.lit(True))).isEmpty():
                raise ValueError(f"{label} must be as long as the {name} grid")
        apertures = spectra.select("s").distinct()
        if not losvd.join(apertures, "s", "left_anti").isEmpty():
            raise ValueError("a histogram must belong to an aperture")
        if pixels is not None and not pixels.join(apertures, F.col("bin") == F.col("s"), "left_anti").isEmpty():
            raise ValueError("a pixel's bin must be an aperture")
        n_c = losvd.agg(F.max("c")).first()[0]
        n_p = templates.count()
        for name, table in (("axis", axis), ("spectra", spectra), ("losvd", losvd), ("templates", templates), ("pixels", pixels)):
            if table is not None:
                self.write(name, table)
        if prior is not None:
            whole = prior.groupBy("c").agg(F.sum(F.greatest("w", F.lit(0.0))).alias("w"))
            total = whole.agg(F.sum("w").alias("t"), F.count("*").alias("k"))
            self.write("comp_prior", whole.crossJoin(F.broadcast(total)).select("c", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1 / F.col("k")).alias("w")))  # one row
        self.set_metadata(n_s=spectra.count(), n_l=sizes["observed"][0], n_t=sizes["template"][0], n_v=sizes["velocity"][0], n_c=int(n_c) + 1 if n_c is not None else 0, pop_shape=list(pop_shape or [n_p, 1, 1]), complete=False)

    def axis(self, name: str) -> np.ndarray:
        """One spectral or velocity axis, a few thousand numbers."""
        return np.array([r["coord"] for r in self.table("axis").where(F.col("name") == name).orderBy("idx").select("coord").collect()])

    def mask(self) -> DataFrame:
        return self.table("axis").where("name = 'observed'").select(F.col("idx").alias("l"), "keep", "weight")

    def spectrum(self, s: int) -> DataFrame:
        return self.table("spectra").where(F.col("s") == s)

    def plane(self, s: int) -> DataFrame:
        """The models of one aperture: its tile's folder, its rows."""
        return self.table("models").where((F.col("tile") == s // self.tile_size) & (F.col("s") == s))

    def apertures(self, selection: str | None) -> DataFrame:
        """Models of the apertures that ``start:count`` or ``i,j,k`` names."""
        picked = parse_selection(selection, int(self.metadata()["n_s"]))
        return self.table("models").where(matches_any("tile", sorted({s // self.tile_size for s in picked})) & matches_any("s", picked))

    def tiles(self) -> DataFrame:
        return self.table("spectra").select(F.floor(F.col("s") / self.tile_size).cast("int").alias("tile")).distinct()

    def newest(self, paths: Sequence[str]) -> str | None:
        """The path whose files were changed last."""
        rows = [(r[0], p) for p in paths if (r := self.spark.read.parquet(p).select("_metadata.file_modification_time").agg(F.max("file_modification_time")).first())[0] is not None]
        return max(rows)[1] if rows else None
