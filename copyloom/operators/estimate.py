"""Copies of classes in samples: expected ends by GC, the control regions that set the scale, and estimates with their status.

A curve has a rate for each sample and GC percentage, null where it has no support. What doesn't depend on the sample (which
GC each position's window has, where a read is callable) is summed by bin first and only then met with the samples' curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.operators import intervals, models, sinks
from copyloom.session import kept

#: GC share of anchor bins; ends in them below which all bins set the level; bins of which so much is usable have copies.
ANCHOR_GC, ANCHOR_ENDS, USABLE = (0.40, 0.60), 1000, 0.5
#: A region departs by more than REGION, a chromosome by more than CHROMOSOME, both by more than Z errors; regions a chromosome needs.
REGION, CHROMOSOME, Z, REGIONS = 0.30, 0.04, 5.0, 3
#: A position without a window has this GC.
UNDEFINED = -1


def whole_curve(curve: DataFrame) -> DataFrame:
    """(sample, gc, rate) with a row for each percentage, and one for positions without a window; rate is null without support."""
    spark = curve.sparkSession
    every = curve.select("sample").distinct().join(F.broadcast(spark.range(UNDEFINED, 101).select(F.col("id").alias("gc"))))  # 102 rows
    return every.join(curve.select("sample", F.col("gc").cast("long").alias("gc"), "rate"), ["sample", "gc"], "left")


def position_gc(units: DataFrame, length: int) -> DataFrame:
    """(class, pos, reverse, gc): for each position and strand, the GC percentage of the window that a fragment ending there
    covers: forward from the position on, reverse up to it. units: (class, seq, circular); UNDEFINED where the window leaves
    a linear unit or holds anything but ACGT."""
    size = F.length("seq")
    seq = F.when(F.col("circular"), F.concat("seq", F.substring("seq", 1, length - 1))).otherwise(F.col("seq"))
    win = models.gc_windows(units.select(F.struct("class", size.alias("size")).alias("unit"), seq.alias("seq")), [length])
    win = win.select("unit.class", F.col("unit.size").alias("size"), "off", "gc").where("off < size")
    both = win.select("class", F.col("off").alias("pos"), F.lit(False).alias("reverse"), "gc").unionByName(
        win.select("class", ((F.col("off") + length - 1) % F.col("size")).alias("pos"), F.lit(True).alias("reverse"), "gc")
    )
    every = units.select("class", F.explode(F.sequence(F.lit(0), size - 1)).alias("pos"), F.array(F.lit(False), F.lit(True)).alias("both")).select("class", F.col("pos").cast("long").alias("pos"), F.explode("both").alias("reverse"))
    return every.join(both, ["class", "pos", "reverse"], "left").withColumn("gc", F.coalesce("gc", F.lit(UNDEFINED).cast("long")))


def strand_bins(positions: DataFrame, callable_: DataFrame, curve: DataFrame, observed: DataFrame, width: int) -> DataFrame:
    """(sample, class, bin, reverse, usable, exp, gc, positions, obs): a bin is usable if a read is callable and the curve has support at
    each of its positions. positions as position_gc gives them; callable_: (class, pos, reverse, ok); curve as whole_curve gives it;
    observed: (sample, class, bin, reverse, n)."""
    at = positions.join(callable_, ["class", "pos", "reverse"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    cells = at.groupBy("class", F.floor(F.col("pos") / width).alias("bin"), "reverse", "gc").agg(F.count(F.lit(1)).alias("n_"), F.count_if("ok").alias("ok_"))
    met = cells.join(curve, "gc")
    held = F.when(F.col("rate").isNotNull(), F.col("ok_")).otherwise(0)
    bins = met.groupBy("sample", "class", "bin", "reverse").agg(
        F.min(held == F.col("n_")).alias("usable"), F.coalesce(F.sum(held * F.col("rate")), F.lit(0.0)).alias("exp"),
        (F.sum(F.when(F.col("gc") >= 0, F.col("gc") * F.col("n_"))) / F.sum(F.when(F.col("gc") >= 0, F.col("n_"))) / 100).alias("gc"), F.sum(held).alias("positions"),
    )
    return bins.join(observed.select("sample", "class", "bin", "reverse", F.col("n").alias("obs")), ["sample", "class", "bin", "reverse"], "left").withColumn("obs", F.coalesce("obs", F.lit(0)))


def _copies(obs: Column, exp: Column) -> Column:
    return F.when(exp > 0, 2 * obs / exp)


def windows(bins: DataFrame, per: int, width: int, lengths: DataFrame | None = None) -> DataFrame:
    """(sample, class, start, end, gc, obs, exp, usable, cn) of `per` bins each, both strands; cn is null where too little is usable. The last window ends with its unit, where lengths
    (class, length) are given."""
    use = F.col("usable")
    at = bins.groupBy("sample", "class", F.floor(F.col("bin") / per).alias("w_")).agg(
        F.coalesce(F.avg(F.when(use, F.col("gc"))), F.avg("gc")).alias("gc"), F.coalesce(F.sum(F.when(use, F.col("obs"))), F.lit(0)).alias("obs"),
        F.coalesce(F.sum(F.when(use, F.col("exp"))), F.lit(0.0)).alias("exp"), F.avg(use.cast("int")).alias("usable"), F.max("bin").alias("last_"),
    )
    cn = F.when(F.col("usable") >= USABLE, _copies(F.col("obs"), F.col("exp")))
    end = (F.col("last_") + 1) * width
    if lengths is not None:
        at, end = at.join(lengths.select("class", F.col("length").alias("length_")), "class", "left"), F.least(end, F.coalesce("length_", end))
    return at.select("sample", "class", (F.col("w_") * per * width).alias("start"), end.alias("end"), "gc", "obs", "exp", "usable", cn.alias("cn"))


def _inside(intervals: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """The bins that lie wholly inside intervals (class, start, end)."""
    first, last = F.ceil(F.col("start") / width), F.floor(F.col("end") / width) - 1
    return intervals.where(first <= last).select(*keep, F.explode(F.sequence(first, last)).alias("bin")).distinct()


def positional(bins: DataFrame, anchors: DataFrame, per: int, width: int, flat: float | None = None, ends: int = ANCHOR_ENDS) -> DataFrame:
    """(sample, class, cn, cn_basis, cn_all, n_all, cn_anchor, n_anchor, cn_all_flat, cn_median, window_log_sd, usable_fraction).

    Anchor bins are usable, of middling GC, and inside the class's anchors (class, start, end) if it has any; they give the headline if they
    hold enough ends. flat is the rate without a GC model."""
    inside = _inside(anchors, width, ["class"]).withColumn("in_", F.lit(True))
    at = bins.join(inside, ["class", "bin"], "left").join(anchors.select("class").distinct().withColumn("has_", F.lit(True)), "class", "left")
    use = F.col("usable")
    anchor = use & F.col("gc").between(*ANCHOR_GC) & (F.col("has_").isNull() | F.col("in_").isNotNull())
    got = at.groupBy("sample", "class").agg(
        *(F.coalesce(F.sum(F.when(m, F.col(c))), F.lit(0)).alias(f"{n}_{k}") for k, m in (("all", use), ("anchor", anchor)) for n, c in (("n", "obs"), ("e", "exp"))),
        F.coalesce(F.sum(F.when(use, F.col("positions"))), F.lit(0)).alias("p_"), F.avg(use.cast("int")).alias("usable_fraction"),
    )
    all_, anchored = (_copies(F.col(f"n_{k}"), F.col(f"e_{k}")) for k in ("all", "anchor"))
    win = windows(bins, per, width).where("cn is not null").groupBy("sample", "class").agg(
        F.percentile("cn", 0.5).alias("cn_median"), F.when(F.count_if(F.col("cn") > 0) > 2, F.stddev_pop(F.when(F.col("cn") > 0, F.log("cn")))).alias("window_log_sd")
    )
    plain = F.lit(None).cast("double") if flat is None else _copies(F.col("n_all"), F.col("p_") * flat)
    basis = F.when(F.col("n_anchor") >= ends, "anchor").otherwise("all")
    got = got.join(win, ["sample", "class"], "left").select("sample", "class", basis.alias("cn_basis"), all_.alias("cn_all"), "n_all", anchored.alias("cn_anchor"), "n_anchor", plain.alias("cn_all_flat"), "cn_median", "window_log_sd", "usable_fraction")
    return got.withColumn("cn", F.when(F.col("cn_basis") == "anchor", F.col("cn_anchor")).otherwise(F.col("cn_all")))


def features(bins: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(sample, class, feature, cn, n, gc): copies over the usable bins wholly inside a feature (class, feature, start, end); gc is over all its bins."""
    at = bins.join(_inside(named, width, ["class", "feature"]), ["class", "bin"])
    use = F.col("usable")
    got = at.groupBy("sample", "class", "feature").agg(F.coalesce(F.sum(F.when(use, F.col("obs"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(use, F.col("exp"))), F.lit(0.0)).alias("e_"), F.avg("gc").alias("gc"))
    return got.select("sample", "class", "feature", _copies(F.col("n"), F.col("e_")).alias("cn"), "n", "gc")


def compositional(reads: DataFrame, curve: DataFrame) -> DataFrame:
    """(sample, class, mass_bp, gc_supported_fraction, mean_read_gc) of reads by their own GC (sample, class, gc, n): reads over the rate of their GC, over
    the share of reads that has one. No reads are a mass of 0; reads of which none has a rate are none."""
    at = reads.join(curve.where("rate is not null"), ["sample", "gc"], "left")
    got = at.groupBy("sample", "class").agg(F.sum("n").alias("t_"), F.sum(F.when(F.col("rate").isNotNull(), F.col("n"))).alias("k_"), F.sum(F.col("n") / F.col("rate")).alias("m_"), F.sum(F.col("n") * F.col("gc")).alias("g_"))
    covered = F.coalesce("k_", F.lit(0)) / F.greatest("t_", F.lit(1))
    mass = F.when(F.col("t_") == 0, F.lit(0.0)).when(F.col("k_") > 0, F.col("m_") / F.greatest(covered, F.lit(1e-9)))
    return got.select("sample", "class", mass.alias("mass_bp"), covered.alias("gc_supported_fraction"), (F.col("g_") / F.greatest("t_", F.lit(1)) / 100).alias("mean_read_gc"))


def region_expected(regions: DataFrame, tables: DataFrame, curve: DataFrame) -> DataFrame:
    """regions (sample, region, chrom, len, obs) with exp: the rates of the region's positions (region, gc, n), scaled to all its position-strands
    where some have no support or no window."""
    at = tables.join(curve, "gc").groupBy("sample", "region").agg(F.sum(F.col("n") * F.col("rate")).alias("s_"), F.sum(F.when(F.col("rate").isNotNull(), F.col("n"))).alias("k_"), F.sum("n").alias("t_"))
    part = F.coalesce(F.col("k_"), F.lit(0)) / F.greatest("t_", F.lit(1))
    exp = F.coalesce("s_", F.lit(0.0)) / F.greatest(part, F.lit(1e-9)) * 2 * F.col("len") / F.greatest("t_", F.lit(1))
    return regions.join(at, ["sample", "region"]).withColumn("exp", exp).drop("s_", "k_", "t_")


def natural(name: Column) -> Column:
    """A sort key that orders chr2 before chr10."""
    return F.concat(F.regexp_extract(name, r"^(\D*)", 1), F.lpad(F.regexp_extract(name, r"(\d+)", 1), 12, "0"), F.regexp_extract(name, r"^\D*\d*(.*)$", 1))


def control_qc(regions: DataFrame, region: float = REGION, chromosome: float = CHROMOSOME, z: float = Z, least: int = REGIONS) -> DataFrame:
    """(sample, rescale, n_regions, n_flagged_regions, flagged, untestable, region_log_sd): control regions and whole chromosomes
    whose depth departs from what the curve expects, both far and significantly, are left out of the scale.

    regions: (sample, region, chrom, obs, exp), control regions only. A chromosome is tested by its own regions, without those that depart from its own
    median, against the level of all kept regions outside the chromosomes flagged so far, up to five times; what is kept by
    chromosome is one short list a sample."""
    lr = F.log(F.greatest(F.col("obs") / F.greatest("exp", F.lit(1e-9)), F.lit(1e-9)))
    at = kept(regions.withColumn("lr_", lr).withColumn("se_", 1 / F.sqrt(F.greatest("exp", F.lit(1.0)))), "regions")
    mid = at.groupBy("sample").agg(F.percentile("lr_", 0.5).alias("mid_"), F.percentile("se_", 0.5).alias("error_"))
    at = at.join(mid, "sample")
    spread = at.groupBy("sample").agg(F.percentile(F.abs(F.col("lr_") - F.col("mid_")), 0.5).alias("mad_"))
    at = at.join(spread, "sample").withColumn("phi_", F.greatest(F.lit(1.0), F.pow(1.4826 * F.col("mad_") / F.col("error_"), 2)))
    at = at.join(at.groupBy("sample", "chrom").agg(F.percentile("lr_", 0.5).alias("own_")), ["sample", "chrom"])
    out = lambda c: (F.abs(F.col("lr_") - F.col(c)) > region) & (F.abs(F.col("lr_") - F.col(c)) > z * F.sqrt("phi_") * F.col("se_"))
    at = kept(at.withColumn("keep_", ~out("mid_")).withColumn("mine_", ~out("own_")), "judged-regions")
    some = lambda m, c: F.coalesce(F.sum(F.when(F.col(m), F.col(c).cast("double"))), F.lit(0.0))
    by = at.groupBy("sample", "chrom").agg(F.count_if("mine_").alias("n"), some("mine_", "obs").alias("o"), some("mine_", "exp").alias("e"), some("keep_", "obs").alias("ko"), some("keep_", "exp").alias("ke"), F.count_if("keep_").alias("kn"), F.sum("obs").cast("double").alias("ao"), F.sum("exp").alias("ae"), F.count(F.lit(1)).alias("an"), F.first("phi_").alias("phi"))
    cs = by.withColumn("chrom", F.col("chrom").cast("string")).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(natural(F.col("chrom").cast("string")).alias("k"), "chrom", "n", "o", "e", "ko", "ke", "kn", "ao", "ae", "an", "phi"))).alias("cs"))
    left_in = lambda field, f: f"aggregate(filter(cs, d -> not array_contains({f}, d.chrom)), 0d, (s, d) -> s + d.{field})"
    departs = f"abs(ln(c.o / c.e) - ln({left_in('ko', 'f')} / {left_in('ke', 'f')}))"
    flagged = F.expr(f"aggregate(sequence(1, 5), cast(array() as array<string>), (f, i) -> transform(filter(cs, c -> c.n >= {least} and {departs} > {chromosome} and {departs} > {z} * sqrt(c.phi / c.e)), c -> c.chrom))")
    total = lambda field: f"aggregate(cs, 0d, (s, d) -> s + d.{field})"
    cs = kept(cs.withColumn("flagged", flagged), "flagged")
    qc = cs.select(
        "sample", F.expr(f"({left_in('ko', 'flagged')} / {left_in('ke', 'flagged')}) / ({total('ao')} / {total('ae')})").alias("rescale"), F.expr(f"cast({total('an')} as long)").alias("n_regions"),
        F.expr(f"cast({total('an')} - {left_in('kn', 'flagged')} as long)").alias("n_flagged_regions"), "flagged", F.expr(f"transform(filter(cs, c -> c.n < {least}), c -> c.chrom)").alias("untestable"),
    )
    left = at.where("keep_").join(qc.select("sample", "flagged"), "sample").where(~F.array_contains("flagged", F.col("chrom").cast("string")))
    left = left.join(left.groupBy("sample").agg(F.percentile("lr_", 0.5).alias("c_")), "sample")
    return qc.join(left.groupBy("sample").agg((1.4826 * F.percentile(F.abs(F.col("lr_") - F.col("c_")), 0.5)).alias("region_log_sd")), "sample", "left")


#: Why a class is counted but not measured, first reason first.
STATUS = ("no_sinks_in_fetch", "sinks_skipped", "panel_mismatch", "subset_only", "unverified")


def class_status(classes: DataFrame, found: dict[str, DataFrame], experimental: DataFrame | None = None) -> DataFrame:
    """(sample, class, status) of classes (sample, class): the first of STATUS for which found has the class (sample, class), else experimental for classes
    whose unit is an experimental one (class), else ok."""
    at = classes
    for k, name in enumerate(STATUS):
        if name in found:
            at = at.join(found[name].select("sample", "class").distinct().withColumn(f"s{k}_", F.lit(name)), ["sample", "class"], "left")
    if experimental is not None:
        at = at.join(experimental.select("class").distinct().withColumn("e_", F.lit("experimental")), "class", "left")
    told = [c for c in at.columns if c.endswith("_") and c not in classes.columns]
    return at.select("sample", "class", F.coalesce(*told, F.lit("ok")).alias("status"))


def estimate(status: DataFrame, positional_: DataFrame, compositional_: DataFrame) -> DataFrame:
    """One row for each class of a sample: what was measured of it, and its status; every value is null unless the status is ok or experimental.
    An experimental class has no anchors, so all its bins set its level; its error is what its windows differ by and the count of its ends."""
    measured = F.col("status").isin("ok", "experimental")
    odd = F.col("status") == "experimental"
    at = status.join(positional_, ["sample", "class"], "left").join(compositional_, ["sample", "class"], "left")
    at = at.withColumn("cn", F.when(odd, F.col("cn_all")).otherwise(F.col("cn"))).withColumn("cn_basis", F.when(odd & F.col("cn_basis").isNotNull(), F.lit("all")).otherwise(F.col("cn_basis")))
    for c in ("cn_anchor", "n_anchor"):
        at = at.withColumn(c, F.when(~odd, F.col(c)))
    values = [c for c in at.columns if c not in ("sample", "class", "status")]
    return at.select("sample", "class", "status", *(F.when(measured, F.col(c)).alias(c) for c in values))


def relative_error(cn: DataFrame) -> DataFrame:
    """(sample, class, cn_se_rel) from windows (sample, class, cn, obs): the error of the mean log copies of windows, and of the count of all ends; null with fewer than three windows of some copies, or without ends."""
    some = F.col("cn") > 0
    got = cn.groupBy("sample", "class").agg(F.var_samp(F.when(some, F.log("cn"))).alias("v_"), F.count_if(some).alias("k_"), F.sum("obs").alias("n_"))
    told = (F.col("k_") >= 3) & (F.col("n_") > 0)
    return got.select("sample", "class", F.when(told, F.sqrt(F.col("v_") / F.col("k_") + 1 / F.col("n_"))).alias("cn_se_rel"))


def option_status(options: DataFrame, samples: DataFrame, beds: DataFrame) -> DataFrame:
    """(sample, option, status) of what a sample says of an option: ok for whole scans (mode is not fetch); of a fetch, ok if the intervals it read are known and hold the option's, not_fetched if
    they lack some, unverified if they aren't known. options: (option, class, contig, start, end); samples: (sample, mode, sinks); beds: (sinks, class, contig, start, end)."""
    joined = intervals.merge(beds.select("sinks", "class", "contig", "start", "end"), ["sinks", "class", "contig"]).select("sinks", "class", "contig", F.col("start").alias("s_"), F.col("end").alias("e_"))
    held = options.join(joined, ["class", "contig"]).where("s_ <= start and end <= e_").select("sinks", "option", "contig", "start", "end").distinct().groupBy("sinks", "option").agg(F.count(F.lit(1)).alias("held_"))
    asked = options.select("option", "contig", "start", "end").distinct().groupBy("option").agg(F.count(F.lit(1)).alias("all_"))
    at = samples.join(F.broadcast(asked), F.lit(True)).join(beds.select("sinks").distinct().withColumn("known_", F.lit(True)), "sinks", "left").join(held, ["sinks", "option"], "left")
    status = F.when(F.col("mode") != "fetch", "ok").when(F.col("known_").isNull(), "unverified").when(F.coalesce("held_", F.lit(0)) < F.col("all_"), "not_fetched").otherwise("ok")
    return at.select("sample", "option", status.alias("status"))


def sub_options(placed: DataFrame, options: DataFrame, per_read: DataFrame, width: int, contigs: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """(sample, option, class, reads, mass): the reads of a class in placement bins wholly inside an option's intervals, times what a read of the class is
    worth. placed: (sample, class, contig, start, reads); options: (option, class, contig, start, end); per_read: (sample, class, worth). A bin ends with its contig, where contigs (contig, length)
    are given. With status, as option_status() gives it, there is a column for it; reads that weren't fetched are null, and so is the mass of all that isn't ok."""
    bed = options.select(F.col("option").alias("class"), "contig", "start", "end")
    at = placed.join(options.select("option", "class").distinct(), "class").select("sample", F.col("option").alias("class"), "contig", "start", "reads")
    ends = contigs if contigs is not None else placed.sparkSession.createDataFrame([], f"contig {placed.schema['contig'].dataType.simpleString()}, length long")
    held = sinks.inside(at.withColumn("contig", F.col("contig").cast("string")), bed.withColumn("contig", F.col("contig").cast("string")), ends.withColumn("contig", F.col("contig").cast("string")), width).groupBy("sample", F.col("class").alias("option")).agg(F.sum("reads").alias("reads"))
    every = per_read.join(options.select("option", "class").distinct(), "class").join(held, ["sample", "option"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    if status is None:
        return every.select("sample", "option", "class", "reads", (F.col("reads") * F.col("worth")).alias("mass"))
    every = every.join(status, ["sample", "option"], "left")
    return every.select("sample", "option", "class", F.when(F.col("status") != "not_fetched", F.col("reads")).alias("reads"), F.when(F.col("status") == "ok", F.col("reads") * F.col("worth")).alias("mass"), "status")
