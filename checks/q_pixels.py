"""Pixel jobs over the embeddings read as 8 x 8 grey frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.registry import query
from checks.views import shape
from tidewait.operators import pixels as px

# One camera; the label is the hour, the id spreads frames over fourteen days.
shape("o_fr", """
select vec_id as frame_id, cast(label as int) as hour, timestamp '2024-01-01' + to_days(cast(vec_id%14 as int)) + to_hours(cast(label as int)) + to_seconds(cast(vec_id%3600 as int)) as captured_at, embedding from {embeddings}""")
shape("o_px", """
select frame_id, hour, captured_at, pos-1 as pos, cast(floor((cast(x as double)+0.6)*212) as int) as v from (
 select frame_id, hour, captured_at, unnest(embedding) as x, generate_subscripts(embedding,1) as pos from o_fr)""")
shape("o_sampled", """
select frame_id, hour, n from (select *, row_number() over (partition by hour order by captured_at, frame_id)-1 as r, count(*) over (partition by hour) as n from o_fr)
where n<=48 or exists (select 1 from range(48) t(i) where (i*n)//48=r)""")
shape("o_bg", """
select p.hour, pos, list_sort(list(v))[count(*)//2+1] as bg, count(*) as samples from o_px p join o_sampled s on s.frame_id=p.frame_id where s.n>=40 group by 1,2""")
shape("o_lit", """
select frame_id, case when ref<>0 then seen/ref else 0 end as ratio, case when seen<>0 then ref/seen else 1 end as scale from (
 select frame_id, cast(list_sort(list(v))[57] as double) as seen, cast(list_sort(list(bg))[57] as double) as ref from o_px join o_bg using (hour, pos) group by 1)""")
shape("o_lane", """
select frame_id, pos//8+1 as lane, avg(case when abs(least(255, cast(floor(v*scale) as int)) - bg) > 22 then 1.0e0 else 0.0e0 end) as share from o_px join o_bg using (hour, pos) join o_lit using (frame_id) group by 1,2""")
shape("o_occ", """
select frame_id, count(*) filter (share>0.15) as used, coalesce(string_agg(cast(lane as string), ',' order by lane) filter (share>0.15),'') as occupied, bool_or(lane=1 and share>0.15) as last_lane from o_lane group by 1""")
# Each position as one image row, the last being the nearest.
shape("o_tail", """
select frame_id, min(pos) filter (seen>=8 and hits/seen>=0.7) as tail from (
 select frame_id, pos, row_number() over w as seen, sum(case when abs(least(255, cast(floor(v*scale) as int)) - bg) > 30 then 1 else 0 end) over w as hits
 from o_px join o_bg using (hour, pos) join o_lit using (frame_id) window w as (partition by frame_id order by pos desc)) group by 1""")
shape("o_tailed", "select *, 500.0e0/(tail+10) - 500.0e0/70 as vehicles from o_tail")
shape("o_strip", """
select frame_id, pos//8 as y, x0, pos%8 as x, v, e from o_px join (values (3.4e0,1),(4.3e0,2)) b(e,x0) on pos%8 between x0 and x0+4""")
shape("o_drift", """
select frame_id, case when count(*) filter (painted)>=8 then (list_sort(list(off) filter (painted)))[count(*) filter (painted)//2+1] else 'infinity'::double end as drift from (
 select frame_id, y, x0, abs(arg_max(x, (v,-x)) - any_value(e)) as off, max(v) - list_sort(list(v))[3] >= 8 as painted from o_strip group by 1,2,3) group by 1""")


class Frames:
    def __init__(self, b: Bound):
        self.b = b
        rows = b.table("embeddings")
        self.frames = rows.select(
            F.col("vec_id").alias("frame_id"), *one_camera("vec_id"),
            F.expr(
                "timestamp'2024-01-01' + make_dt_interval(cast(vec_id % 14 as int), cast(label as int), 0, cast(vec_id % 3600 as int))"
            ).alias("captured_at"),
            F.transform("embedding", lambda x: F.floor((x.cast("double") + 0.6) * 212).cast("int")).alias("pixels"),
        )
        self.now = F.lit("2024-01-15").cast("timestamp")

    @property
    def background(self) -> DataFrame:
        sample = px.background_sample(self.frames, self.now, self.b.params)
        return px.hourly_background(sample, self.frames)

    @property
    def paired(self) -> DataFrame:
        hour = self.frames.withColumn("hour", F.hour("captured_at"))
        return hour.join(self.background, px.BUCKET)

    @property
    def lit(self) -> DataFrame:
        return px.with_illumination(self.paired, F.sequence(F.lit(0), F.lit(63)))

    @property
    def lanes(self) -> DataFrame:
        return px.lane_shares(self.lit.withColumn("lanes", lane_table()))


def one_camera(key: str):
    """The one camera of these frames, read off a row so that joins on it stay equality joins."""
    return F.when(F.col(key) >= 0, "A").alias("terminal"), F.when(F.col(key) >= 0, "main").alias("camera")


def lane_table():
    return F.transform(
        F.sequence(F.lit(1), F.lit(8)),
        lambda i: F.struct(i.alias("lane"), F.sequence((i - 1) * 8, i * 8 - 1).alias("positions")),
    )


def row_table():
    return F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("row"), F.array(i).alias("positions"))
    )


@query("pix01_luma_frames", "select frame_id, round(avg(v),6) as mean_luma, avg(v)<120 as dark from o_px group by 1")
def _(b: Bound) -> DataFrame:
    from dataclasses import replace

    dim = replace(b.params, dark_luma=120.0)
    return px.with_darkness(Frames(b).frames, dim).select("frame_id", F.round("mean_luma", 6).alias("mean_luma"), "dark")


@query("pix02_hourly_background", "select hour, pos, bg as value, samples from o_bg")
def _(b: Bound) -> DataFrame:
    return Frames(b).background.select("hour", F.posexplode("background").alias("pos", "value"), "samples")


@query("pix03_illumination", "select frame_id, round(ratio,6) as light_ratio, round(scale,6) as scale, ratio between 0.85 and 1.2 as lit from o_lit")
def _(b: Bound) -> DataFrame:
    return Frames(b).lit.select("frame_id", F.round("light_ratio", 6).alias("light_ratio"), F.round("scale", 6).alias("scale"), "lit")


@query("pix04_lane_occupancy", "select frame_id, lane, share from o_lane")
def _(b: Bound) -> DataFrame:
    return Frames(b).lanes.select("frame_id", F.explode("shares").alias("s")).select("frame_id", "s.lane", "s.share")


def _read(b: Bound, covers: bool) -> DataFrame:
    lanes = Frames(b).lanes.withColumns(
        {"covers_compound": F.lit(covers), "lanes_before_capacity": F.col("frame_id") % 2 == 0}
    )
    return px.lane_reading(lanes)


@query("pix05_last_visible_lane", "select frame_id, last_lane as reaches_last_lane, occupied from o_occ")
def _(b: Bound) -> DataFrame:
    return _read(b, True).select(
        "frame_id", "reaches_last_lane", F.array_join(F.array_sort("occupied").cast("array<string>"), ",").alias("occupied")
    )


@query("scl21_band_from_lanes", """
select frame_id, case when used=0 then 'empty' when used/8.0<=0.25 then 'light' when used/8.0<=0.55 then 'moderate' when used<8 then 'heavy' else 'overflowing' end as band,
 case when used>0 then 'heavy' when frame_id%2=0 then 'empty' end as partial_band from o_occ""")
def _(b: Bound) -> DataFrame:
    partial = _read(b, False).select("frame_id", F.col("band").alias("partial_band"))
    return _read(b, True).select("frame_id", "band").join(partial, "frame_id")


@query("scl24_evenly_spaced_sample", "select frame_id, hour, n as offered from o_sampled")
def _(b: Bound) -> DataFrame:
    rows = Frames(b).frames.withColumn("hour", F.hour("captured_at"))
    taken = px.evenly_spaced(rows.select("hour", "captured_at", "frame_id"), ["hour"], ["captured_at", "frame_id"], 48)
    return taken.select("frame_id", "hour", "offered")


LINES = [(y, [3.4, 4.3]) for y in range(8)]


def _drift(b: Bound) -> DataFrame:
    lines = F.array(*[F.struct(F.lit(y).alias("row"), F.array(*map(F.lit, xs)).alias("xs")) for y, xs in LINES])
    camera = b.spark.range(1).select(*one_camera("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), lines.alias("boundaries"))
    return px.calibration_drift(Frames(b).frames, camera, search=2)


@query("pix06_calibration_drift", "select frame_id, drift = 'infinity'::double as unmeasured, round(case when drift < 100 then drift end, 6) as drift from o_drift")
def _(b: Bound) -> DataFrame:
    endless = F.col("drift") == float("inf")
    return _drift(b).select(
        "frame_id", endless.alias("unmeasured"), F.when(~endless, F.round("drift", 6)).alias("drift")
    )


def _extent(b: Bound) -> DataFrame:
    geometry = {"far_row": 4, "camera_row": 60.0, "horizon": -10.0, "station_scale": 500.0}
    shared = px.row_shares(Frames(b).lit.withColumn("rows", row_table()))
    return px.extent_reading(shared.withColumns({k: F.lit(v) for k, v in geometry.items()}))


@query("pix07_queue_tail", "select frame_id, tail from o_tail")
def _(b: Bound) -> DataFrame:
    return _extent(b).select("frame_id", "tail")


@query("pix08_vehicles_to_tail", """
select frame_id, round(vehicles,6) as vehicles, coalesce(vehicles>=4,false) as queue, coalesce(vehicles>=4,false) and tail<=4 as saturated from o_tailed""")
def _(b: Bound) -> DataFrame:
    return _extent(b).select("frame_id", F.round("vehicles", 6).alias("vehicles"), "queue", F.coalesce("saturated", F.lit(False)).alias("saturated"))


@query("pix09_read_lane_frames", """
select frame_id, case when good then used end as lanes_occupied, good and last_lane as beyond, case when good then band end as band, case when good then round(greatest(0.5e0, 1-drift/6),3) else 0 end as confidence, good as usable, case when good then 'clear' else 'obscured' end as visibility
from (select *, ratio between 0.85 and 1.2 and drift<=3 as good, case when used=0 then 'empty' when used/8.0<=0.25 then 'light' when used/8.0<=0.55 then 'moderate' when used<8 then 'heavy' else 'overflowing' end as band
 from o_occ join o_lit using (frame_id) join o_drift using (frame_id))""")
def _(b: Bound) -> DataFrame:
    calibration = b.spark.range(1).select(
        *one_camera("id"), lane_table().alias("lanes"),
        F.lit(True).alias("covers_compound"), F.lit(False).alias("lanes_before_capacity"),
    )
    read = px.read_lane_frames(_drift(b), Frames(b).background, calibration, b.params)
    return read.select("frame_id", "lanes_occupied", "beyond", "band", "confidence", "usable", "visibility")


@query("pix10_read_extent_frames", """
select frame_id, case when lit then tail end as tail, case when lit then round(vehicles,1) end as vehicles, case when lit and vehicles>=4 then 'heavy' end as band, lit as usable,
 case when not lit then 0 when tail is null then 0.9 when vehicles<4 then 0.5 when tail<=4 then 0.7 else 0.9 end::double as confidence, lit and coalesce(vehicles>=4 and tail<=4, false) as beyond
from (select *, ratio between 0.85 and 1.2 as lit from o_tailed join o_lit using (frame_id))""")
def _(b: Bound) -> DataFrame:
    calibration = b.spark.range(1).select(
        *one_camera("id"), row_table().alias("rows"),
        F.sequence(F.lit(0), F.lit(63)).alias("light_positions"), F.lit(4).alias("far_row"),
        F.lit(60.0).alias("camera_row"), F.lit(-10.0).alias("horizon"), F.lit(500.0).alias("station_scale"),
    )
    read = px.read_extent_frames(Frames(b).frames, Frames(b).background, calibration, b.params)
    return read.select("frame_id", "tail", "vehicles", "band", "usable", "confidence", F.coalesce("beyond", F.lit(False)).alias("beyond"))
