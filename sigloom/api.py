"""A fluent interface: ``Reads(df).trim().scale().posterior(model, params).basecall(model)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sigloom.functions.sequence import guess_alphabet
from sigloom.kernels.networks import RAW, SQUIGGLE, model_stride
from sigloom.operators import reads
from sigloom.plans import pipelines

__all__ = ["RAW", "SQUIGGLE", "Reads", "guess_alphabet", "model_stride"]


@dataclass(frozen=True)
class Reads:
    """Reads with a signal column; every method returns new ones."""

    df: DataFrame

    def trim(self, head: int = 200, tail: int = 10, chunk: int = 100, quantile: float = 0.0) -> Reads:
        return Reads(reads.trim(self.df, head, tail, chunk, quantile))

    def scale(self) -> Reads:
        """By median and MAD over the trimmed view."""
        return Reads(reads.normalise(self.df))

    def detect_events(self, **detection) -> Reads:
        return Reads(reads.detect_events(self.df, pipelines.Detection(**detection)))

    def posterior(self, model: str, params: dict, **opts) -> Reads:
        return Reads(reads.posterior(self.df, model, params, **opts))

    def basecall(self, model: str, base_probs: bool = False, **opts) -> Reads:
        """Decode a posterior, without homopolymer correction unless asked for; base_probs is for CRF models only."""
        out = reads.decode_post(self.df, model, **opts)
        if base_probs and not RAW[model].crf:
            raise ValueError("base probabilities need a CRF model")
        return Reads(reads.crf_posterior(out) if base_probs else out)

    def map_to_sequence(self, **opts) -> Reads:
        return Reads(reads.map_post_to_sequence(self.df, **opts))

    def map_to_squiggle(self, **opts) -> Reads:
        return Reads(reads.map_signal_to_squiggle(self.df, **opts))

    def squiggle(self, model: str, params: dict, rescale: bool = False) -> Reads:
        return Reads(reads.squiggle(self.df, model, params, rescale))
