"""Errors of the engine, by the layer that raises them."""


class WarpError(Exception):
    """Base of all; keyword arguments become attributes and make the message."""

    def __init__(self, **facts):
        super().__init__(", ".join(f"{k}={v!r}" for k, v in facts.items()))
        self.__dict__.update(facts)


class DtwError(WarpError): ...
class EmptySeries(DtwError): ...
class NonFiniteValue(DtwError): ...
class ConstantSeries(DtwError): ...
class TooShort(DtwError): ...
class UnequalLengths(DtwError): ...


class ClusterError(WarpError): ...
class EmptyCluster(ClusterError): ...
class InvalidK(ClusterError): ...
class InvalidKRange(ClusterError): ...
class TooFewSeries(ClusterError): ...
class SingleCluster(ClusterError): ...
class InvalidConfig(ClusterError): ...


class RfError(WarpError): ...
class InvalidTreeCount(RfError): ...
class InvalidMaxFeatures(RfError): ...
class InvalidMaxDepth(RfError): ...
class InvalidMinSamplesSplit(RfError): ...
class InvalidMinSamplesLeaf(RfError): ...
class InvalidFoldCount(RfError): ...
class TooFewSamplesForFolds(RfError): ...
class EmptyTraining(RfError): ...
class ZeroFeatures(RfError): ...
class FeatureCountMismatch(RfError): ...
class NonFiniteFeature(RfError): ...
class PredictionFeatureMismatch(RfError): ...
class OobEvaluationFailed(RfError): ...
class ModelVersionMismatch(RfError): ...


class IoError(WarpError): ...
class SourceNotFound(IoError): ...
class EmptyDataset(IoError): ...
class NoFeatureColumns(IoError): ...
class InconsistentRowLength(IoError): ...
class DuplicateId(IoError): ...
class NonFiniteCell(IoError): ...
class EmptyId(IoError): ...
class MissingAttributes(IoError): ...
class InvalidExperimentName(IoError): ...
