"""A burst job: normalise, recover, align, warp, merge, map and quantise one burst of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..operators import align, exposure, merge, repair, reshape, stats, stencil, tone, wiener
from .settings import Settings

Progress = Callable[[float, str], None]


@dataclass(frozen=True)
class Sensor:
    """What all frames of a raw burst share: the mosaic's period (0: planes of a demosaiced image), the colour (0 red, 1 green, 2 blue) of each of its cells, black levels of the cells (0: the mean) and the colour factors."""

    period: int = 0
    pattern: tuple[int, ...] = (0, 1, 1, 2)
    blacks: tuple[float, ...] = ()
    colour: tuple[float, float, float] = (1.0, 1.0, 1.0)


class BurstJob:
    """px holds one burst of equal frames, frames one row each (ev, bias, white, black; a burst has few).

    A mosaic of one channel and a period over 1 is taken apart into planes first
    and put together again at the end.  The frames' sizes and levels are read once.
    """

    def __init__(self, px: DataFrame, frames: DataFrame, settings: Settings = Settings(), colour: tuple[float, float, float] = (1.0, 1.0, 1.0), raw: bool = True, sensor: Sensor | None = None, progress: Progress | None = None):
        self.px, self.frames, self.settings, self.raw = px, frames, settings, raw
        self.sensor = sensor or Sensor(colour=colour)
        self.progress = progress or (lambda share, stage: None)

    @cached_property
    def size(self) -> tuple[int, int, int]:
        """Width, height and channels; an error if frames differ in them."""
        each = self.px.groupBy("frame").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("c").alias("c"))
        found = each.select("x", "y", "c").distinct().limit(2).collect()
        if len(found) > 1:
            raise ValueError("frames of a burst differ in size or channels")
        if not found:
            raise ValueError("no frames")
        return found[0].x + 1, found[0].y + 1, found[0].c + 1

    @cached_property
    def meta(self) -> list:
        """The rows of frames in order; an error if demosaiced frames are mixed with others."""
        rows = self.frames.orderBy("frame").collect()
        if "period" in self.frames.columns and len({r["period"] == 0 for r in rows}) > 1:
            raise ValueError("demosaiced frames cannot be mixed with mosaic ones in a burst")
        return rows

    @cached_property
    def classes(self):
        return exposure.classify(self.frames).first()

    @property
    def bracketed(self) -> bool:
        return self.raw and self.classes["is_bracketed"]

    def field(self, gray: DataFrame, refs: DataFrame, width: int, height: int, levels: list[DataFrame] | None = None) -> tuple[DataFrame, int]:
        s = self.settings
        if s.align == "standard":
            seeds = align.global_search(gray, refs, s.tile, width, height)
            field, spacing = align.standard_field(gray, refs, s.tile, width, height, s.search, seeds), s.tile
        else:
            field, spacing = align.dense_field(gray, refs, s.tile, width, height, s.align == "frequency", s.weighted, levels), s.tile // 2
        return (align.smooth_field(field) if s.smooth else field), spacing

    def aligned(self, px: DataFrame, scaled: DataFrame, width: int, height: int, white: float) -> DataFrame:
        """Comparisons warped onto the reference, with the reference itself."""
        if self.settings.align == "skip":
            return px
        refs = scaled.select("burst", "ref").distinct()
        first = refs.first()
        burst, ref = first["burst"], first["ref"]
        px = checkpointed(px)  # each search and each warp reads it
        gray = lambda some: reshape.gray_gamma(some, self.settings.gamma, white)
        own = px.where(F.col("frame") == ref)
        if not (self.raw and self.classes["needs_chained"]):
            all_gray = gray(px)
            levels = None if self.settings.align == "standard" else align.cached_pyramid(all_gray, width, height, self.settings.tile)
            field, spacing = self.field(all_gray, refs, width, height, levels)
            return own.unionByName(stencil.warp_aligned(px.where(F.col("frame") != ref), field, spacing, width, height))
        done = {ref: own}
        order = align.chained_order([(e["ev"], e["frame"]) for e in self.classes["exposure_order"]], ref, [r["frame"] for r in self.meta])
        for i, (child, parent) in enumerate(order):
            self.progress(0.2 + 0.4 * i / len(order), f"aligning frame {child} to {parent}")
            moving = px.where(F.col("frame") == child)
            here = px.sparkSession.createDataFrame([(burst, parent)], "burst int, ref int")
            field, spacing = self.field(gray(moving.unionByName(done[parent])), here, width, height)
            done[child] = checkpointed(stencil.warp_aligned(moving, field, spacing, width, height))
        out = None
        for x in done.values():
            out = x if out is None else out.unionByName(x)
        return out

    def recovered(self, px: DataFrame, scaled: DataFrame, channels: int, span: float) -> DataFrame:
        """Clipped highlights of the greens from the other colours, by the layout of the channels; the range follows each frame's exposure scale."""
        s = self.sensor
        positive = lambda v: v if v > 0 else 1.0
        green = positive(s.colour[1])
        f_r, f_b = (positive(s.colour[i] / green) for i in (0, 2))
        if span <= 0:
            return px
        factor = F.when(F.col("frame") == F.col("ref"), 1.0).otherwise(F.col("scale"))
        unit_px = merge.with_frames(px, scaled).withColumn("v", F.col("v") / factor).select(*px.columns)  # so that one range holds for all frames
        back = lambda out: merge.with_frames(out, scaled).withColumn("v", F.col("v") * factor).select(*out.columns)
        if s.period == 2 and channels == 4:
            return back(repair.recover_bayer(unit_px, span, f_r, f_b, s.pattern))
        if s.period == 0 and channels == 3:
            return back(repair.recover_linear(unit_px, span, f_r, f_b))
        if s.period >= 3 and channels == s.period**2:
            return back(repair.recover_mosaic(unit_px, span, f_r, f_b, s.pattern))
        return px

    def planes(self) -> tuple[DataFrame, int, int, int]:
        """The frames as planes, with their width, height and channels."""
        width, height, channels = self.size
        p = self.sensor.period
        if self.raw and channels == 1 and p > 1:
            return reshape.mosaic_to_planes(self.px, p), -(-width // p), -(-height // p), p * p
        return self.px, width, height, channels

    def merged(self) -> DataFrame:
        s = self.settings
        self.progress(0.0, "reading frames")
        white, black = self.meta[0]["white"], self.meta[0]["black"]
        px, width, height, channels = self.planes()
        if not (channels in (1, 3, 4) or channels == self.sensor.period**2):
            raise ValueError("frames have 1, 3 or 4 channels, or one for each cell of a mosaic")
        frames = self.frames if self.raw else self.frames.withColumn("ev", F.lit(0.0))
        scaled = exposure.scales(frames, exposure.select_reference(frames))
        if self.raw:
            if s.hot_pixels and (self.sensor.period > 0 or channels == 1):
                phases = max(2, self.sensor.period) if channels == 1 else 1
                blacks = [b or black for b in self.sensor.blacks] or black
                step = phases if channels == 1 else 2
                px = repair.repair_hot_pixels(px, repair.hot_pixels(px, blacks, step, phases), step)
            self.progress(0.1, "normalising frames")
            px = reshape.normalize(px, scaled)
            if s.recovery and channels > 1:
                px = self.recovered(px, scaled, channels, white - black)
        self.progress(0.2, "aligning frames")
        px = merge.with_frames(self.aligned(px, scaled, width, height, white), scaled)
        self.progress(0.6, f"merging frames ({s.merge})")
        clip = 0.98 * (white - black) if white > black + 1 else None
        if s.merge == "average":
            return merge.temporal_average_weighted(px, white, black) if self.raw and white > black + 1 else merge.temporal_average(px)
        if s.merge == "median":
            return merge.temporal_median(px, clip).drop("n_kept")
        if s.merge == "expbracket":
            return merge.expbracket_average(px, clip or 0.0)
        plain = px if self.bracketed else px.withColumn("wn", F.lit(1.0))
        if s.merge == "frequency":
            if s.frequency_mode == "laplacian":
                return merge.laplacian(plain, s.tile)
            return wiener.merge(plain, s.noise_reduction, s.frequency_mode == "wiener-robust", self.bracketed, white, black if self.raw else 0.0)
        one = px.where(F.col("frame") == F.col("ref")).select("burst", "frame", "y", "x", "c", "v")
        block = self.sensor.period if self.raw and self.sensor.period >= 2 else 2
        if s.spatial_linear:
            noise = stats.linear_noise(one, block).first()["noise"]
        else:
            noise = min(stats.noise_floor(one, max(1, self.sensor.period if self.raw else 1)).first()["noise"], max(8.0, 4 * s.noise_reduction))
        return merge.spatial(px, noise, stats.robustness(s.noise_reduction), white, black if self.raw else 0.0, multi=channels > 1, linear=s.spatial_linear, weighted=self.bracketed, block=block, chroma=channels >= 4)

    def toned(self, out: DataFrame) -> DataFrame:
        """Bit depth, black level, exposure and per-cell black offsets of a merged raw frame."""
        s, white, black = self.settings, self.meta[0]["white"], self.meta[0]["black"]
        target = tone.target_white(s.depth, white)
        out = out.withColumn("v", tone.bit_depth(F.col("v"), s.depth, white, black))
        if s.exposure != "off" and s.stops:
            low = s.depth <= 10
            top = float(round((white - black) * target / white)) if low else target
            level = 0.0 if low else black * target / white
            if s.exposure == "linear":
                out = tone.exposure_linear(out, s.stops, top)
            elif s.exposure == "curve":
                out = out.withColumn("v", tone.exposure_curve(F.col("v"), s.stops, top))
            else:
                out = tone.reinhard_local(out, s.stops, top, level, level, 1 if self.sensor.period > 1 else 2)
        if s.depth > 10 and black > 1 and len(self.sensor.blacks) == 4 and self.planes()[3] == 4:
            out = out.withColumn("v", tone.black_delta(F.col("v"), F.col("c"), list(self.sensor.blacks), black, target / white))
        return out

    def run(self) -> DataFrame:
        """Quantised pixels of the result (burst, y, x, c, v int); a mosaic comes out as one."""
        s, out = self.settings, self.merged()
        white = self.meta[0]["white"]
        if not self.raw:
            out = out.withColumn("v", tone.quantize(F.col("v"), white, 2.0 ** tone.snap_depth(s.depth, "png") - 1))
        else:
            self.progress(0.8, "mapping tones")
            out = self.toned(out)
            width, height, channels = self.size
            p = self.sensor.period
            if channels == 1 and p > 1:
                out = reshape.planes_to_mosaic(out.withColumn("frame", F.lit(0)), p, width, height).drop("frame")
            out = out.withColumn("v", tone.quantize(F.col("v"), tone.target_white(s.depth, white)))
        self.progress(1.0, "done")
        return out
