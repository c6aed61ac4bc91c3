"""SQL equivalents of the queries, for checking results against another engine.

They are written separately from the DataFrame code: key events are looked up by joins on row ids, and
sequences are counted per side.
"""

from __future__ import annotations

from keyspan.plans.queries import HARD, HARD_HOT, SKEWED

GAZE = """
ev AS (
  SELECT event_id, user_id, event_type, value,
         60 + CAST(floor(value * 8) AS BIGINT) AS dur,
         CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 26) AS INTEGER) AS chunk
  FROM events
), timed AS (
  SELECT *, sum(dur) OVER (PARTITION BY user_id, chunk ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto FROM ev
), gaze AS (
  SELECT event_id AS RowId,
         'R' || CAST(user_id % 5 AS INTEGER) AS Recording,
         'P' || user_id AS Participant,
         CASE (user_id + chunk) % 12
           WHEN 0 THEN 'FPEn' WHEN 1 THEN 'PEn' WHEN 2 THEN 'FPEt' WHEN 3 THEN 'PEt'
           WHEN 4 THEN 'FPEn2' WHEN 5 THEN 'PEn2' WHEN 6 THEN 'EA' WHEN 7 THEN 'FPEn3'
           WHEN 8 THEN 'PEn3' WHEN 9 THEN 'FPEn4' WHEN 10 THEN 'PEn4' ELSE 'Other' END AS TOI,
         CAST(floor(chunk / 2) AS INTEGER) + 1 AS "Interval",
         CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_type IN ('click', 'view') THEN 'Fixation'
              WHEN event_type IN ('purchase', 'signup') THEN 'Saccade'
              ELSE 'Unclassified' END AS Event_type,
         CASE WHEN event_id % 13 = 0 THEN 'Partial' ELSE 'Whole' END AS Validity,
         CAST(upto - dur AS DOUBLE) AS "Start",
         CAST(upto AS DOUBLE) AS "Stop",
         CAST(dur AS DOUBLE) AS Duration,
         CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(value) AS DOUBLE) / 8 END AS Saccade_amplitude
  FROM timed
)"""

KEYED = """
covering AS (
  SELECT Recording, Participant, TOI, "Interval", min(RowId) AS key_row
  FROM gaze WHERE "Start" <= 5000 AND "Stop" > 5000 GROUP BY ALL
), label_key AS (
  SELECT c.Recording, c.Participant, c.TOI, c."Interval",
         g."Start" AS KeyEventStart, g."Stop" AS KeyEventStop, g.Event_type AS KeyEventType
  FROM covering c JOIN gaze g ON g.RowId = c.key_row
), label_first AS (
  SELECT Recording, Participant, TOI, "Interval", min(RowId) AS first_row FROM gaze GROUP BY ALL
), label_order AS (
  SELECT k.*, f.first_row FROM label_key k JOIN label_first f USING (Recording, Participant, TOI, "Interval")
), lead_label AS (
  SELECT Recording, Participant, "Interval", min(first_row) AS first_row FROM label_order GROUP BY ALL
), lead_type AS (
  SELECT Recording, Participant, "Interval", min(first_row) AS first_row
  FROM label_order WHERE KeyEventType IS NOT NULL GROUP BY ALL
), interval_key AS (
  SELECT l.Recording, l.Participant, l."Interval", o.KeyEventStart, o.KeyEventStop, t.KeyEventType
  FROM lead_label l
  JOIN label_order o ON o.first_row = l.first_row
  LEFT JOIN lead_type lt
    ON lt.Recording = l.Recording AND lt.Participant = l.Participant AND lt."Interval" = l."Interval"
  LEFT JOIN label_order t ON t.first_row = lt.first_row
), keyed AS (
  SELECT g.*, k.KeyEventStart, k.KeyEventStop, k.KeyEventType
  FROM gaze g JOIN interval_key k USING (Recording, Participant, "Interval")
)"""

BEFORE = "('FPEn', 'FPEn2', 'FPEn3', 'FPEn4', 'FPEt')"
AFTER = "('PEn', 'PEn2', 'PEn3', 'PEn4', 'PEt')"
FPENX = "('FPEn', 'FPEn2', 'FPEn3', 'FPEn4')"
PENX = "('PEn', 'PEn2', 'PEn3', 'PEn4')"
RELEVANT = "('FPEn', 'FPEn2', 'FPEn3', 'FPEn4', 'FPEt', 'PEn', 'PEn2', 'PEn3', 'PEn4', 'PEt')"
SIDE = f"""((TOI IN {BEFORE} AND "Stop" <= KeyEventStop) OR (TOI IN {AFTER} AND "Start" >= KeyEventStart))"""

ALIGNED = f"""
aligned AS (
  SELECT * FROM keyed WHERE TOI IN {RELEVANT} AND Validity = 'Whole' AND {SIDE}
)"""

SEQD = """
key_rows AS (
  SELECT RowId, CAST(0 AS BIGINT) AS seq FROM aligned WHERE "Start" = KeyEventStart AND "Stop" = KeyEventStop
), before_rows AS (
  SELECT RowId, -row_number() OVER (
           PARTITION BY Recording, Participant, TOI, "Interval", Event_type
           ORDER BY "Stop" DESC, "Start", RowId) AS seq
  FROM aligned WHERE "Stop" <= KeyEventStart
), after_rows AS (
  SELECT RowId, row_number() OVER (
           PARTITION BY Recording, Participant, TOI, "Interval", Event_type ORDER BY "Start", RowId) AS seq
  FROM aligned WHERE "Start" > KeyEventStart
), numbers AS (
  SELECT * FROM key_rows UNION ALL SELECT * FROM before_rows UNION ALL SELECT * FROM after_rows
), seqd AS (
  SELECT a.*,
         CASE WHEN a.Event_type = 'Fixation' THEN CAST(n.seq AS BIGINT) END AS FixationSequence,
         CASE WHEN a.Event_type = 'Saccade' THEN CAST(n.seq AS BIGINT) END AS SaccadeSequence
  FROM aligned a LEFT JOIN numbers n USING (RowId)
)"""

FINAL = """
big AS (
  SELECT Recording, Participant, TOI, "Interval" FROM seqd GROUP BY ALL HAVING count(*) >= 10
), final AS (
  SELECT s.* FROM seqd s JOIN big USING (Recording, Participant, TOI, "Interval")
)"""

STATS = """
fix_stats AS (
  SELECT Recording, avg(Duration) AS mean_dur, stddev_samp(Duration) AS sd, count(*) AS n
  FROM final WHERE Event_type = 'Fixation' GROUP BY ALL
), sacc_stats AS (
  SELECT Recording, avg(Saccade_amplitude) AS mean_amp, stddev_samp(Saccade_amplitude) AS sd, count(*) AS n
  FROM final WHERE Event_type = 'Saccade' GROUP BY ALL
), marked AS (
  SELECT f.*,
         CASE WHEN Event_type = 'Fixation' THEN coalesce(
                (x.sd IS NULL OR x.sd = 0 OR abs(Duration - mean_dur) <= 3 * x.sd) AND Duration IS NOT NULL, FALSE)
              WHEN Event_type = 'Saccade' THEN coalesce(
                (s.sd IS NULL OR s.sd = 0 OR abs(Saccade_amplitude - mean_amp) <= 3 * s.sd)
                AND Saccade_amplitude IS NOT NULL, FALSE)
              ELSE TRUE END AS kept
  FROM final f LEFT JOIN fix_stats x USING (Recording) LEFT JOIN sacc_stats s USING (Recording)
), filtered AS (SELECT * EXCLUDE (kept) FROM marked WHERE kept)"""


def _profile(source: str, name: str) -> str:
    return f"""
{name}_typed AS (
  SELECT Participant, Recording, TOI, Event_type,
         CASE WHEN TOI IN {FPENX} THEN 'Combined_FPEnX' WHEN TOI IN {PENX} THEN 'Combined_PEnX'
              WHEN TOI IN ('FPEt', 'PEt', 'EA') THEN TOI END AS TOI_Category,
         FixationSequence AS Sequence, Duration AS Metric
  FROM {source} WHERE Event_type = 'Fixation'
  UNION ALL
  SELECT Participant, Recording, TOI, Event_type,
         CASE WHEN TOI IN {FPENX} THEN 'Combined_FPEnX' WHEN TOI IN {PENX} THEN 'Combined_PEnX'
              WHEN TOI IN ('FPEt', 'PEt', 'EA') THEN TOI END,
         SaccadeSequence, Saccade_amplitude
  FROM {source} WHERE Event_type = 'Saccade'
), {name} AS (
  SELECT Participant, Recording, TOI, TOI_Category, Event_type, Sequence, Metric FROM {name}_typed
  WHERE Metric IS NOT NULL AND (
    (TOI_Category IN ('Combined_FPEnX', 'FPEt', 'EA') AND Sequence IN (-5, -4, -3, -2, -1))
    OR (TOI_Category IN ('Combined_PEnX', 'PEt') AND Sequence IN (0, 1, 2, 3, 4, 5)))
)"""


PREP = _profile("seqd", "prep")
PREP_FILTERED = _profile("filtered", "prepf")

SEQ0 = """
seq0 AS (
  SELECT *, coalesce(FixationSequence, SaccadeSequence) AS Sequence FROM seqd
  WHERE coalesce(FixationSequence, SaccadeSequence) = 0 AND isfinite(Duration)
)"""

TO_KEYED = (GAZE, KEYED)
TO_ALIGNED = (*TO_KEYED, ALIGNED)
TO_SEQD = (*TO_ALIGNED, SEQD)
TO_FINAL = (*TO_SEQD, FINAL)
TO_STATS = (*TO_FINAL, STATS)
TO_PREP = (*TO_SEQD, PREP)
TO_PREP_FILTERED = (*TO_STATS, PREP_FILTERED)
TO_SEQ0 = (*TO_SEQD, SEQ0)

ORDER_OF = """CASE TOI_Category WHEN 'Combined_FPEnX' THEN 1 WHEN 'FPEt' THEN 2
                WHEN 'Combined_PEnX' THEN 3 WHEN 'PEt' THEN 4 END"""


def _sql(ctes: tuple[str, ...], select: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + select.strip()


def _per_participant(labels: str, suffix: str = "") -> str:
    return f"""
SELECT Recording, Participant,
       avg(Duration) FILTER (Event_type = 'Fixation') AS AvgFixDuration{suffix},
       count(*) FILTER (Event_type = 'Fixation') AS N_Fix{suffix},
       avg(Saccade_amplitude) FILTER (Event_type = 'Saccade') AS AvgSaccAmplitude{suffix},
       count(*) FILTER (Event_type = 'Saccade') AS N_Sacc{suffix}
FROM final WHERE TOI IN {labels} GROUP BY Recording, Participant"""


def _by_type(labels: str, name: str, column: str) -> str:
    return f"""
SELECT '{name}' AS {column}, Event_type,
       CASE WHEN Event_type = 'Fixation' THEN avg(Duration) END AS AvgDuration,
       CASE WHEN Event_type = 'Saccade' THEN avg(Saccade_amplitude) END AS AvgAmplitude,
       count(*) AS N
FROM final WHERE TOI IN {labels} AND Event_type IS NOT NULL GROUP BY Event_type
HAVING NOT (Event_type = 'Fixation' AND count(Duration) = 0)
   AND NOT (Event_type = 'Saccade' AND count(Saccade_amplitude) = 0)"""


def _long(labels: str, name: str, order: int | None = None) -> str:
    position = "" if order is None else f", {order} AS CategoryOrder"
    return f"""
SELECT '{name}' AS Category, Event_type, 'AvgDuration' AS MetricType, avg(Duration) AS AvgMetric, count(*) AS N{position}
FROM final WHERE TOI IN {labels} AND Event_type = 'Fixation' GROUP BY Event_type HAVING count(Duration) > 0
UNION ALL
SELECT '{name}', Event_type, 'AvgAmplitude', avg(Saccade_amplitude), count(*){position}
FROM final WHERE TOI IN {labels} AND Event_type = 'Saccade' GROUP BY Event_type HAVING count(Saccade_amplitude) > 0"""


def _overlay(keys: str, source: str, fixed: str = "", extra: str = "") -> str:
    """Scaled series; ``keys`` identify an entity, ``extra`` are further point keys."""
    points = ", ".join(part for part in (keys, extra, "Event_type, Sequence") if part)
    constant = f"'{fixed}' AS TOI_Combination, " if fixed else ""
    entity = keys or "TOI_Combination"
    order = f", {ORDER_OF} AS CategoryOrder" if extra else ""
    return f"""
, points AS (
  SELECT {constant}{points}{order}, avg(Metric) AS AvgMetric, count(*) AS N
  FROM {source} GROUP BY {points}
), spans AS (
  SELECT {entity},
         max(AvgMetric) FILTER (Event_type = 'Fixation') - min(AvgMetric) FILTER (Event_type = 'Fixation') AS fix_span,
         max(AvgMetric) FILTER (Event_type = 'Saccade') - min(AvgMetric) FILTER (Event_type = 'Saccade') AS sacc_span
  FROM points GROUP BY {entity} HAVING count(*) >= 2 AND count(DISTINCT Event_type) = 2
), factors AS (
  SELECT {entity}, CASE WHEN fix_span > 0 AND sacc_span > 0 THEN fix_span / sacc_span ELSE 1 END AS ScalingFactor
  FROM spans
)
SELECT p.*, ScalingFactor,
       CASE WHEN Event_type = 'Saccade' THEN AvgMetric * ScalingFactor ELSE AvgMetric END AS ScaledMetric
FROM points p JOIN factors USING ({entity})"""


def _mean_median(keys: str) -> str:
    return f"""
SELECT {keys}, avg(Metric) AS MeanMetric, quantile_cont(Metric, 0.5) AS MedianMetric, count(*) AS N,
       {ORDER_OF} AS CategoryOrder
FROM prepf GROUP BY {keys}"""


def _series(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS N, {ORDER_OF} AS CategoryOrder, 'MeanMetric' AS Stat, avg(Metric) AS Value
FROM prepf GROUP BY {keys}
UNION ALL
SELECT {keys}, count(*), {ORDER_OF}, 'MedianMetric', quantile_cont(Metric, 0.5) FROM prepf GROUP BY {keys}"""


def _numeric_summary(value: str, event_type: str) -> str:
    return f"""
SELECT min({value}) AS "Min", quantile_cont({value}, 0.25) AS Q25, quantile_cont({value}, 0.5) AS "Median",
       avg({value}) AS Mean, quantile_cont({value}, 0.75) AS Q75, max({value}) AS "Max",
       count(*) FILTER ({value} IS NULL) AS N_Null
FROM final WHERE Event_type = '{event_type}'"""


def _histogram(value: str, event_type: str) -> str:
    return f"""
, vals AS (SELECT {value} AS v FROM final WHERE Event_type = '{event_type}' AND {value} IS NOT NULL),
ends AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM vals),
placed AS (
  SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((v - lo) / w), 49) AS INTEGER) END AS b, lo, w FROM vals, ends
)
SELECT b AS Bin, lo + b * w AS BinStart, count(*) AS "Count" FROM placed GROUP BY b, lo, w"""


def _two_fields(first: str, second: str, source: str) -> str:
    return f"""
SELECT DISTINCT '{first}' AS Field, {first} AS Value FROM {source}
UNION ALL SELECT DISTINCT '{second}', {second} FROM {source}"""


SUMMARY_PER_LABEL = """
, f AS (SELECT Recording, Participant, TOI, avg(Duration) AS AvgFixationDuration, count(*) AS N_Fixations
        FROM final WHERE Event_type = 'Fixation' GROUP BY ALL),
s AS (SELECT Recording, Participant, TOI, avg(Saccade_amplitude) AS AvgSaccadeAmplitude, count(*) AS N_Saccades
      FROM final WHERE Event_type = 'Saccade' GROUP BY ALL)
SELECT * FROM f FULL JOIN s USING (Recording, Participant, TOI)"""
FIXATIONS_WITH_SACCADES = """
, f AS (SELECT Recording, Participant, TOI, RowId, Duration FROM {source} WHERE Event_type = 'Fixation'),
s AS (SELECT Recording, Participant, TOI, avg(Saccade_amplitude) AS AvgSaccadeAmplitude, count(*) AS N_Saccades
      FROM {source} WHERE Event_type = 'Saccade' GROUP BY ALL),
same AS (SELECT f.*, s.AvgSaccadeAmplitude, CAST(s.N_Saccades AS BIGINT) AS N_Saccades
         FROM f LEFT JOIN s ON f.Recording IS NOT DISTINCT FROM s.Recording
           AND f.Participant IS NOT DISTINCT FROM s.Participant AND f.TOI IS NOT DISTINCT FROM s.TOI)
SELECT * FROM same
UNION ALL
SELECT Recording, Participant, TOI, NULL, NULL, AvgSaccadeAmplitude, N_Saccades FROM s
WHERE NOT EXISTS (FROM f WHERE f.Recording IS NOT DISTINCT FROM s.Recording
                    AND f.Participant IS NOT DISTINCT FROM s.Participant AND f.TOI IS NOT DISTINCT FROM s.TOI)"""
WITH_MISSING_KEYS = """
, fewer_keys AS (
  SELECT * REPLACE (CASE WHEN RowId % 5 >= 2 THEN Recording END AS Recording,
                    CASE WHEN RowId % 5 >= 2 THEN Participant END AS Participant,
                    CASE WHEN RowId % 5 >= 2 THEN TOI END AS TOI) FROM final)"""
SEQ0_DETAILED = """
SELECT Recording, Participant, "Interval", TOI, Event_type, "Start", "Stop", Duration, Validity,
       FixationSequence, SaccadeSequence, Sequence, KeyEventStart, KeyEventStop, KeyEventType FROM seq0"""
SEQUENCE_COLUMNS = 'RowId, Recording, Participant, "Interval", TOI, "Start", "Stop"'
FOUR_KEYS = "TOI_Category, Event_type, Sequence"
SEQ0_PER_RECORDING = "SELECT Recording, avg(Duration) AS AvgDuration_Seq0, count(*) AS N_Seq0_Events FROM seq0 GROUP BY 1"


def all_oracle_sql() -> dict[str, str]:
    """The SQL of every query; how rows are spread makes no difference to it."""
    usual = _usual_oracle_sql()
    hard = _hard_oracle_sql(usual)
    usual["hard_fixations_with_saccades"] = _sql(
        (HARD_GAZE, HARD_KEYED), WITH_MISSING_KEYS + FIXATIONS_WITH_SACCADES.format(source="fewer_keys")
    )
    usual["fixations_with_saccades"] = _sql(TO_FINAL, FIXATIONS_WITH_SACCADES.format(source="final"))
    usual["appended_events"] = usual["sequenced_events"]
    usual |= {f"hard_{name}": hard[name] for name in HARD} | {f"hard_{name}_split": hard[name] for name in HARD_HOT}
    return usual | {name: usual[of] for name, (of, _) in SKEWED.items()}


# The table of hard cases. Its keys may be NULL, so that its stages are written with windows and null-safe conditions.
HARD_GAZE = (
    GAZE.replace("gaze AS (", "plain AS (")
    + """, numbered AS (SELECT *, CAST(substr(Participant, 2) AS BIGINT) AS u FROM plain
), gaze AS (
  SELECT RowId,
         CASE WHEN u % 3 = 0 THEN 'R0' WHEN u % 7 <> 1 THEN Recording END AS Recording,
         CASE WHEN u % 3 = 0 THEN 'PX' WHEN u % 7 <> 2 THEN Participant END AS Participant,
         TOI,
         CASE WHEN u % 3 = 0 THEN 1 WHEN NOT (u % 5 = 1 AND "Interval" = 2) THEN "Interval" END AS "Interval",
         Event_type, Validity,
         CASE WHEN RowId % 31 = 5 THEN NULL WHEN RowId % 4 = 0 THEN floor("Start" / 512) * 512
              ELSE "Start" + CAST(RowId % 8 AS DOUBLE) / 8 END AS "Start",
         CASE WHEN RowId % 37 = 6 THEN NULL WHEN RowId % 4 = 0 THEN floor("Stop" / 512) * 512 + 512
              ELSE "Stop" + CAST(RowId % 8 AS DOUBLE) / 8 END AS "Stop",
         CASE WHEN RowId % 41 = 1 THEN NULL WHEN RowId % 997 = 7 THEN CAST('inf' AS DOUBLE)
              ELSE Duration + CAST(RowId % 16 AS DOUBLE) / 16 END AS Duration,
         CASE WHEN RowId % 43 <> 2 THEN Saccade_amplitude + CAST(RowId % 32 AS DOUBLE) / 1024 END AS Saccade_amplitude
  FROM numbered
)"""
)

HARD_KEYED = """
covered AS (
  SELECT Recording, Participant, "Interval", TOI, min(RowId) AS first_row,
         min(RowId) FILTER (WHERE "Start" <= 5000 AND "Stop" > 5000) AS key_row
  FROM gaze GROUP BY ALL
), label_rows AS (
  SELECT c.*, g."Start" AS KeyEventStart, g."Stop" AS KeyEventStop, g.Event_type AS KeyEventType
  FROM covered c JOIN gaze g ON g.RowId = c.key_row
), label_key AS (SELECT * EXCLUDE (first_row, key_row) FROM label_rows
), interval_key AS (
  SELECT Recording, Participant, "Interval", arg_min(KeyEventStart, first_row) AS KeyEventStart,
         arg_min(KeyEventStop, first_row) AS KeyEventStop,
         arg_min(KeyEventType, first_row) FILTER (WHERE KeyEventType IS NOT NULL) AS KeyEventType
  FROM label_rows GROUP BY ALL
), aligned AS (
  SELECT g.*, k.KeyEventStart, k.KeyEventStop, k.KeyEventType
  FROM gaze g JOIN interval_key k ON g.Recording IS NOT DISTINCT FROM k.Recording
    AND g.Participant IS NOT DISTINCT FROM k.Participant AND g."Interval" IS NOT DISTINCT FROM k."Interval"
  WHERE g.TOI IN (SELECT unnest(['FPEn', 'FPEn2', 'FPEn3', 'FPEn4', 'FPEt', 'PEn', 'PEn2', 'PEn3', 'PEn4', 'PEt']))
    AND g.Validity = 'Whole'
    AND CASE WHEN g.TOI LIKE 'F%' THEN g."Stop" <= k.KeyEventStop ELSE g."Start" >= k.KeyEventStart END
), sided AS (
  SELECT *, CASE WHEN "Start" = KeyEventStart AND "Stop" = KeyEventStop THEN 0
                 WHEN "Stop" <= KeyEventStart THEN -1 WHEN "Start" > KeyEventStart THEN 1 END AS side
  FROM aligned
), ranked AS (
  SELECT *, side * row_number() OVER (
      PARTITION BY Recording, Participant, "Interval", TOI, Event_type, side
      ORDER BY CASE WHEN side = -1 THEN -"Stop" ELSE "Start" END, "Start" NULLS LAST, RowId) AS seq
  FROM sided
), seqd AS (
  SELECT * EXCLUDE (side, seq), CASE WHEN Event_type = 'Fixation' THEN seq END AS FixationSequence,
         CASE WHEN Event_type = 'Saccade' THEN seq END AS SaccadeSequence
  FROM ranked
), final AS (
  SELECT * FROM seqd QUALIFY count(*) OVER (PARTITION BY Recording, Participant, "Interval", TOI) >= 10
)"""

HARD_SUMMARY_PER_LABEL = """
SELECT Recording, Participant, TOI, avg(Duration) FILTER (WHERE Event_type = 'Fixation') AS AvgFixationDuration,
       nullif(count(*) FILTER (WHERE Event_type = 'Fixation'), 0) AS N_Fixations,
       avg(Saccade_amplitude) FILTER (WHERE Event_type = 'Saccade') AS AvgSaccadeAmplitude,
       nullif(count(*) FILTER (WHERE Event_type = 'Saccade'), 0) AS N_Saccades
FROM final WHERE Event_type IN ('Fixation', 'Saccade') GROUP BY Recording, Participant, TOI"""


def _hard_oracle_sql(usual: dict[str, str]) -> dict[str, str]:
    """The SQL on the table of hard cases: its own stages, and the plain reports on top of them."""
    stages = (HARD_GAZE, HARD_KEYED)
    own = {
        "gaze": "SELECT * FROM gaze",
        "key_event_per_label": "SELECT * FROM label_key",
        "key_event_per_interval": "SELECT * FROM interval_key",
        "aligned_events": "SELECT * FROM aligned",
        "sequenced_events": "SELECT * FROM seqd",
        "min_group_size": "SELECT * FROM final",
        "summary_per_label": HARD_SUMMARY_PER_LABEL,
    }
    # What follows the stages of a plain report reads the table `final` (or `seqd`) alone.
    plain = "WITH" + ",".join(TO_FINAL) + "\n"
    reports = {name: usual[name].removeprefix(plain) for name in HARD if name not in own}
    return {name: _sql(stages, select) for name, select in (own | reports).items()}


def _usual_oracle_sql() -> dict[str, str]:
    gaze, keyed, aligned, seqd, final = (GAZE,), TO_KEYED, TO_ALIGNED, TO_SEQD, TO_FINAL
    return {
        "gaze": _sql(gaze, "SELECT * FROM gaze"),
        "row_id_report": _sql(
            gaze,
            """
SELECT (SELECT count(*) FROM gaze) AS Rows, (SELECT count(*) FROM gaze WHERE RowId IS NULL) AS N_Null,
       count(*) AS N_Repeated, min(RowId) AS FirstRepeated
FROM (SELECT RowId FROM gaze GROUP BY RowId HAVING count(*) > 1 AND RowId IS NOT NULL)""",
        ),
        "input_order": "SELECT row_number() OVER () - 1 AS RowId, event_id FROM events",
        "key_event_per_label": _sql(keyed, "SELECT * FROM label_key"),
        "key_event_per_interval": _sql(keyed, "SELECT * FROM interval_key"),
        "intervals_with_key_event": _sql(keyed, "SELECT * FROM keyed"),
        "relevant_labels": _sql(gaze, f"SELECT * FROM gaze WHERE TOI IN {RELEVANT}"),
        "valid_rows": _sql(gaze, "SELECT * FROM gaze WHERE Validity = 'Whole'"),
        "side_window_filter": _sql(keyed, f"SELECT * FROM keyed WHERE {SIDE}"),
        "aligned_events": _sql(aligned, "SELECT * FROM aligned"),
        "key_event_consistency": _sql(
            aligned,
            """
SELECT Recording, Participant, "Interval", count(DISTINCT KeyEventStart) AS N_Unique_Start,
       count(DISTINCT KeyEventStop) AS N_Unique_Stop,
       count(DISTINCT KeyEventStart) > 1 OR count(DISTINCT KeyEventStop) > 1 AS Inconsistent
FROM aligned GROUP BY Recording, Participant, "Interval\"""",
        ),
        "spot_check_before": _sql(
            aligned,
            f"""
SELECT Recording, Participant, "Interval", TOI, max("Stop") AS MaxStop, any_value(KeyEventStop) AS KeyEventStop,
       max("Stop") <= any_value(KeyEventStop) AS WithinKeyEvent
FROM aligned WHERE TOI IN {BEFORE} GROUP BY Recording, Participant, "Interval", TOI""",
        ),
        "spot_check_after": _sql(
            aligned,
            f"""
SELECT Recording, Participant, "Interval", TOI, min("Start") AS MinStart, any_value(KeyEventStart) AS KeyEventStart,
       min("Start") >= any_value(KeyEventStart) AS WithinKeyEvent
FROM aligned WHERE TOI IN {AFTER} GROUP BY Recording, Participant, "Interval", TOI""",
        ),
        "remaining_labels": _sql(aligned, _two_fields("TOI", "Validity", "aligned")),
        "fixation_sequence": _sql(
            seqd, f"SELECT {SEQUENCE_COLUMNS}, FixationSequence AS Sequence FROM seqd WHERE Event_type = 'Fixation'"
        ),
        "saccade_sequence": _sql(
            seqd, f"SELECT {SEQUENCE_COLUMNS}, SaccadeSequence AS Sequence FROM seqd WHERE Event_type = 'Saccade'"
        ),
        "sequenced_events": _sql(seqd, "SELECT * FROM seqd"),
        "min_group_size": _sql(final, "SELECT * FROM final"),
        "stage_counts": _sql(
            final,
            """
SELECT 'input' AS Stage, count(*) AS "Rows" FROM gaze UNION ALL SELECT 'aligned', count(*) FROM aligned
UNION ALL SELECT 'sequenced', count(*) FROM seqd UNION ALL SELECT 'final', count(*) FROM final""",
        ),
        "interval_counts": _sql(
            final,
            """
SELECT 'sequenced' AS Stage, count(*) AS "Groups"
FROM (SELECT DISTINCT Recording, Participant, TOI, "Interval" FROM seqd)
UNION ALL SELECT 'final', count(*) FROM (SELECT DISTINCT Recording, Participant, TOI, "Interval" FROM final)""",
        ),
        "summary_rollup": _sql(
            final,
            """
SELECT Recording, Participant, TOI, Event_type, sum(Duration) AS SumDuration, count(Duration) AS N_Duration,
       sum(Saccade_amplitude) AS SumAmplitude, count(Saccade_amplitude) AS N_Amplitude, count(*) AS N_Rows
FROM final GROUP BY ALL""",
        ),
        "fixation_summary_per_label": _sql(
            final,
            """
SELECT Recording, Participant, TOI, avg(Duration) AS AvgFixationDuration, count(*) AS N_Fixations
FROM final WHERE Event_type = 'Fixation' GROUP BY ALL""",
        ),
        "saccade_summary_per_label": _sql(
            final,
            """
SELECT Recording, Participant, TOI, avg(Saccade_amplitude) AS AvgSaccadeAmplitude, count(*) AS N_Saccades
FROM final WHERE Event_type = 'Saccade' GROUP BY ALL""",
        ),
        "summary_per_label": _sql(final, SUMMARY_PER_LABEL),
        "summary_per_label_first_rows": _sql(final, SUMMARY_PER_LABEL + " ORDER BY Recording, Participant, TOI LIMIT 50"),
        "combined_fpen_summary": _sql(final, _per_participant(FPENX, "_All_FPEn")),
        "combined_pen_summary": _sql(final, _per_participant(PENX, "_All_PEn")),
        "before_after_summary": _sql(
            final,
            f"""
SELECT Recording, Participant,
       CASE WHEN TOI IN {AFTER} THEN 'AfterEvent' ELSE 'BeforeEvent' END AS TimeWindowGroup,
       avg(Duration) FILTER (Event_type = 'Fixation') AS AvgFixDuration,
       count(*) FILTER (Event_type = 'Fixation') AS N_Fix,
       avg(Saccade_amplitude) FILTER (Event_type = 'Saccade') AS AvgSaccAmplitude,
       count(*) FILTER (Event_type = 'Saccade') AS N_Sacc
FROM final GROUP BY 1, 2, 3""",
        ),
        "fpet_summary": _sql(final, _per_participant("('FPEt')", "_FPEt")),
        "pet_summary": _sql(final, _per_participant("('PEt')", "_PEt")),
        "overall_four_categories": _sql(
            final,
            "\nUNION ALL".join(
                _by_type(labels, name, "TOI_Category")
                for labels, name in (
                    (FPENX, "Combined_FPEnX"),
                    (PENX, "Combined_PEnX"),
                    ("('FPEt')", "FPEt"),
                    ("('PEt')", "PEt"),
                )
            ),
        ),
        "fpenx_penx_per_participant": _sql(final, _per_participant("('FPEn','FPEn2','FPEn3','FPEn4','PEn','PEn2','PEn3','PEn4')")),
        "fpenx_penx_overall": _sql(
            final,
            _by_type("('FPEn','FPEn2','FPEn3','FPEn4','PEn','PEn2','PEn3','PEn4')", "FPEnX + PEnX", "TOI_Combination"),
        ),
        "fpet_pet_per_participant": _sql(final, _per_participant("('FPEt', 'PEt')")),
        "fpet_pet_overall": _sql(final, _by_type("('FPEt', 'PEt')", "FPEt + PEt", "TOI_Combination")),
        "overall_summary_long": _sql(final, _long(FPENX, "Combined_FPEnX")),
        "all_overall_summaries": _sql(
            final,
            "\nUNION ALL".join(
                _long(labels, name, order)
                for order, (labels, name) in enumerate(
                    (
                        ("('EA')", "EA"),
                        (FPENX, "Combined_FPEnX"),
                        ("('FPEt')", "FPEt"),
                        ("('EA', 'FPEn', 'FPEn2', 'FPEn3', 'FPEn4', 'FPEt')", "Combined_Before"),
                        (PENX, "Combined_PEnX"),
                        ("('PEt')", "PEt"),
                        (AFTER, "Combined_After"),
                    ),
                    start=1,
                )
            ),
        ),
        "sequence_metric_rows": _sql(TO_PREP, "SELECT * FROM prep"),
        "sequence_range_check": _sql(
            TO_PREP,
            """
SELECT TOI_Category, min(Sequence) AS MinSeq, max(Sequence) AS MaxSeq, count(*) AS N_Rows
FROM prep GROUP BY TOI_Category""",
        ),
        "sequence_zero_categories": _sql(TO_PREP, "SELECT DISTINCT TOI_Category FROM prep WHERE Sequence = 0"),
        "profile_per_recording": _sql(
            TO_PREP,
            """
SELECT Recording, Event_type, Sequence, avg(Metric) AS AvgMetric, count(*) AS N,
       CASE Event_type WHEN 'Fixation' THEN 'Avg Fixation Duration (ms)'
                       WHEN 'Saccade' THEN 'Avg Saccade Amplitude (deg)' END AS MetricName
FROM prep GROUP BY Recording, Event_type, Sequence""",
        ),
        "overlay_per_participant": _sql(TO_PREP, _overlay("Participant", "prep")),
        "overlay_per_recording": _sql(TO_PREP, _overlay("Recording", "prep")),
        "overlay_fpenx_penx": _sql(
            TO_PREP,
            _overlay("", "(SELECT * FROM prep WHERE TOI NOT IN ('FPEt', 'PEt', 'EA'))", "FPEnX + PEnX"),
        ),
        "overlay_fpet_pet": _sql(
            TO_PREP, _overlay("", "(SELECT * FROM prep WHERE TOI IN ('FPEt', 'PEt'))", "FPEt + PEt")
        ),
        "overlay_fpen_pen": _sql(
            TO_PREP, _overlay("", "(SELECT * FROM prep WHERE TOI IN ('FPEn', 'PEn'))", "FPEn + PEn")
        ),
        "profile_4groups_per_recording": _sql(
            TO_PREP,
            f"""
SELECT Recording, {FOUR_KEYS}, avg(Metric) AS AvgMetric, count(*) AS N, {ORDER_OF} AS CategoryOrder
FROM prep WHERE TOI <> 'EA' GROUP BY Recording, {FOUR_KEYS}""",
        ),
        "overlay_4groups_per_recording": _sql(
            TO_PREP, _overlay("Recording", "(SELECT * FROM prep WHERE TOI <> 'EA')", extra="TOI_Category")
        ),
        "recordings_with_profiles": _sql(TO_PREP, _two_fields("Recording", "TOI_Category", "prep")),
        "entity_lists": _sql(TO_PREP, _two_fields("Participant", "Recording", "prep")),
        "write_profile_series": _sql(TO_PREP, _overlay("Participant", "prep")),
        "write_recording_series": _sql(TO_PREP, _overlay("Recording", "prep")),
        "fixation_duration_stats": _sql(final, _numeric_summary("Duration", "Fixation")),
        "saccade_amplitude_stats": _sql(final, _numeric_summary("Saccade_amplitude", "Saccade")),
        "implausible_counts": _sql(
            final,
            """
SELECT count(*) FILTER (Event_type = 'Fixation' AND Duration < 80) AS N_Fix_Short,
       count(*) FILTER (Event_type = 'Fixation' AND Duration > 1500) AS N_Fix_Long,
       count(*) FILTER (Event_type = 'Saccade' AND Saccade_amplitude < 1) AS N_Sacc_Small,
       count(*) FILTER (Event_type = 'Saccade' AND Saccade_amplitude > 40) AS N_Sacc_Large
FROM final""",
        ),
        "fixation_histogram": _sql(final, _histogram("Duration", "Fixation")),
        "saccade_histogram": _sql(final, _histogram("Saccade_amplitude", "Saccade")),
        "outlier_stats": _sql(
            TO_STATS,
            """
, sizes AS (SELECT Recording, count(*) AS n_rows FROM final GROUP BY 1)
SELECT Recording, round(x.mean_dur, 6) AS mean_dur,
       CASE WHEN x.sd > 0 THEN round(x.sd, 6) END AS sd_dur, coalesce(x.sd, 0) = 0 AS unbounded_dur,
       round(s.mean_amp, 6) AS mean_amp,
       CASE WHEN s.sd > 0 THEN round(s.sd, 6) END AS sd_amp, coalesce(s.sd, 0) = 0 AS unbounded_amp,
       coalesce(x.n, 0) AS n_fix, coalesce(s.n, 0) AS n_sacc, n_rows
FROM sizes LEFT JOIN fix_stats x USING (Recording) LEFT JOIN sacc_stats s USING (Recording)""",
        ),
        "outlier_filtered": _sql(TO_STATS, "SELECT * FROM filtered"),
        "outlier_removed_counts": _sql(
            TO_STATS,
            """
SELECT count(*) AS N_Before, count(*) FILTER (kept) AS N_After, count(*) FILTER (NOT kept) AS N_Removed FROM marked""",
        ),
        "sequence_metric_rows_filtered": _sql(TO_PREP_FILTERED, "SELECT * FROM prepf"),
        "mean_median_per_recording": _sql(TO_PREP_FILTERED, _mean_median("Recording, " + FOUR_KEYS)),
        "mean_median_overall": _sql(TO_PREP_FILTERED, _mean_median(FOUR_KEYS)),
        "stat_series_per_recording": _sql(TO_PREP_FILTERED, _series("Recording, " + FOUR_KEYS)),
        "stat_series_overall": _sql(TO_PREP_FILTERED, _series(FOUR_KEYS)),
        "seq0_events": _sql(TO_SEQ0, 'SELECT Recording, Participant, "Interval", TOI, Event_type, Duration FROM seq0'),
        "seq0_event_types": _sql(TO_SEQ0, "SELECT Event_type, count(*) AS N FROM seq0 GROUP BY Event_type"),
        "seq0_duration_per_recording": _sql(TO_SEQ0, SEQ0_PER_RECORDING),
        "seq0_duration_overall": _sql(
            TO_SEQ0, "SELECT avg(Duration) AS OverallAvgDuration_Seq0, count(*) AS Total_N_Seq0_Events FROM seq0"
        ),
        "seq0_recording_vs_overall": _sql(
            TO_SEQ0,
            f"SELECT p.*, (SELECT avg(Duration) FROM seq0) AS OverallAvgDuration_Seq0 FROM ({SEQ0_PER_RECORDING}) p",
        ),
        "seq0_events_detailed": _sql(TO_SEQ0, SEQ0_DETAILED),
        "seq0_events_first_rows": _sql(
            TO_SEQ0, SEQ0_DETAILED + ' ORDER BY Recording, Participant, "Interval", TOI, "Start", RowId LIMIT 50'
        ),
    }
