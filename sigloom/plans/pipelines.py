"""The commands as functions from DataFrame to DataFrame. Everything is map-side: one row a read, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import sequence
from sigloom.kernels import networks
from sigloom.kernels.detect import Detection
from sigloom.operators import reads
from sigloom.sources import readers, sinks


def _pair(text: str, second: str | None = None) -> tuple[float, float]:
    """"a:b", or "a" for both (or for the first with a second given)."""
    a, _, b = text.partition(":")
    return float(a), float(b or (a if second is None else second))


@dataclass(frozen=True)
class Options:
    """Defaults of the basecalling commands; checked on creation."""

    model: str = "rgrgr_r94"
    min_prob: float = 1e-5
    stay_penalty: float = 0.0
    skip_penalty: float = 0.0
    local_penalty: float = 2.0
    weight_temperature: float = 1.0
    bias_temperature: float = 1.0
    slip: bool = False
    homopolymer: str = "mean"
    dwell_correction: bool = True
    trim: tuple[int, int] = (200, 10)
    segmentation: tuple[int, float] = (100, 0.0)
    prefix: str = ""
    use_uuid: bool = False
    limit: int = 0
    detection: Detection = field(default_factory=Detection)

    def __post_init__(self) -> None:
        networks.model(self.model)
        if not 0 <= self.min_prob < 1:
            raise ValueError("min_prob lies in [0, 1)")
        if min(self.stay_penalty, self.skip_penalty, self.local_penalty) < 0:
            raise ValueError("penalties aren't negative")
        if min(self.weight_temperature, self.bias_temperature) <= 0:
            raise ValueError("temperatures are positive")
        if self.homopolymer not in ("nochange", "mean"):
            raise ValueError("homopolymer is nochange or mean")
        if min(self.trim) < 0 or self.segmentation[0] < 1 or not 0 <= self.segmentation[1] < 1:
            raise ValueError("trim isn't negative; segmentation is a chunk and a fraction in [0, 1)")
        if self.limit < 0:
            raise ValueError("limit isn't negative")

    @classmethod
    def parse(cls, **texts: str) -> Options:
        """From option strings: trim "200:10", segmentation "100:5" (a percentage)."""
        out: dict = dict(texts)
        if "trim" in texts:
            out["trim"] = tuple(map(int, _pair(texts["trim"])))
        if "segmentation" in texts:
            chunk, percent = _pair(texts["segmentation"], "0")
            out["segmentation"] = (int(chunk), percent / 100)
        for k in ("min_prob", "stay_penalty", "skip_penalty", "local_penalty", "weight_temperature", "bias_temperature"):
            if k in texts:
                out[k] = float(texts[k])
        return cls(**out)

    def trimmed(self, df: DataFrame) -> DataFrame:
        return reads.trim(readers.limited(df, self.limit), *self.trim, *self.segmentation).where("end > start")

    def network(self) -> dict:
        return {"min_prob": self.min_prob, "t_weight": self.weight_temperature, "t_bias": self.bias_temperature}

    def decoder(self) -> dict:
        return {"stay_penalty": self.stay_penalty, "skip_penalty": self.skip_penalty, "local_penalty": self.local_penalty, "slip": self.slip}


def basecall_raw(df: DataFrame, params: dict, options: Options = Options()) -> DataFrame:
    """read_id, uuid, signal -> score, path, bases, pos, nblock, n, start, end. Reads with nothing left or a constant signal are dropped."""
    out = reads.call_signal(options.trimmed(df), options.model, params, options.network(), options.homopolymer, **options.decoder())
    return out.where("bases is not null").withColumn("n", F.size("signal")).drop("signal")


def basecall_events(df: DataFrame, params: dict, options: Options = Options()) -> DataFrame:
    """read_id, uuid, signal -> score, bases, pos, nevent, events with pos and state."""
    out = reads.detect_events(options.trimmed(df), options.detection).drop("signal")
    out = reads.call_events(out, params, options.network(), dwell_correction=options.dwell_correction, **options.decoder()).where("bases is not null")
    call = F.transform("events", lambda e, i: e.withField("pos", F.get("pos", i)).withField("state", F.get("path", i) + 1))
    out = out.withColumn("events", call).withColumn("nevent", F.size("events"))
    return out.withColumn("bases", F.coalesce("corrected", "bases")).drop("corrected", "nblock")


def event_table(df: DataFrame, options: Options = Options()) -> DataFrame:
    """read_id, signal -> events."""
    return reads.detect_events(options.trimmed(df), options.detection).drop("signal")


def predict_squiggle(df: DataFrame, params: dict, model: str = "squiggle_r94", rescale: bool = True, limit: int = 0) -> DataFrame:
    """name, seq -> squiggle; sequences with other letters than A C G T are dropped."""
    out = readers.limited(df, limit).withColumn("states", sequence.encode_kmers(F.col("seq"), 1)).where("states is not null")
    return reads.squiggle(out, model, params, rescale).drop("states")


def map_signal(df: DataFrame, params: dict, model: str = "squiggle_r94", options: Options = Options(), **mapping) -> DataFrame:
    """read_id, signal, seq -> map_score, map_path over the whole signal (-1 outside the trimmed view), squiggle in natural units."""
    out = reads.normalise(options.trimmed(df)).where("normalised is not null").withColumn("states", sequence.encode_kmers(F.col("seq"), 1)).where("states is not null")
    out = reads.map_signal_to_squiggle(reads.squiggle(out, model, params), **mapping)
    whole = F.concat(F.array_repeat(F.lit(-1), F.col("start")), F.col("map_path"), F.array_repeat(F.lit(-1), F.size("signal") - F.col("end")))
    q = F.transform("squiggle", lambda r: F.array(F.get(r, F.lit(0)), F.exp(F.get(r, F.lit(1))), F.exp(-F.get(r, F.lit(2)))))
    return out.withColumn("map_path", whole).withColumn("squiggle", q).drop("normalised", "states")


def map_sequence(df: DataFrame, params: dict, k: int = 5, options: Options = Options(local_penalty=4.0), **mapping) -> DataFrame:
    """read_id, signal, seq -> map_score, map_path of blocks to k-mers. Reads with nothing left or a constant signal are dropped."""
    out = options.trimmed(df).withColumn("states", sequence.encode_kmers(F.col("seq"), k)).where("states is not null")
    penalties = {"stay_penalty": options.stay_penalty, "skip_penalty": options.skip_penalty, "local_penalty": options.local_penalty}
    out = reads.map_signal_to_sequence(out, options.model, params, options.network(), **(penalties | mapping))
    return out.where("map_score is not null").drop("signal", "states")


#: Commands by name: what runs, and how its result is written as text.
COMMANDS = {
    "raw": (basecall_raw, {"fasta": sinks.fasta_raw, "sam": sinks.sam}),
    "events": (basecall_events, {"fasta": sinks.fasta_events, "sam": sinks.sam}),
    "event_table": (event_table, {"tsv": sinks.event_tsv}),
    "squiggle": (predict_squiggle, {"tsv": sinks.squiggle_tsv}),
    "mappy": (map_signal, {"tsv": sinks.mappy_tsv}),
    "seqmappy": (map_sequence, {"tsv": sinks.seqmappy_tsv}),
}


def command(name: str):
    if name not in COMMANDS:
        raise ValueError(f"no command {name!r}; one of {', '.join(COMMANDS)}")
    return COMMANDS[name]
