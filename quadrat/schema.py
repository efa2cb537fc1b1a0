"""The closed column registry of STAR tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the file format, by type.
TEXT = (
    "_rlnMicrographName _rlnImageName _rlnCtfImage _psGhMCFPickle _psPickleFile _psStarFile _psSegImage _psStartSurfIds _psEndSurfIds "
    "_suTomoParticles _suSurfaceVtp _suPartShape _suSurfaceVtpSim _mtCenterLine _mtParticlesTomo _mtMtubesCsv _fbCurve _fbTomoFilaments "
    "_fbXMLFile _omTomoSegmentation _omMbSegmentation _omLmSegmentation"
).split()
INTEGERS = "_rlnGroupNumber _rlnClassNumber _rlnNrOfSignificantSamples _rlnRandomSubset _psSegLabel _psAPClass _psAPCenter _psSurfacePID".split()
NUMBERS = (
    "_rlnCoordinateX _rlnCoordinateY _rlnCoordinateZ _rlnAngleRotPrior _rlnAngleTiltPrior _rlnAnglePsiPrior _rlnAngleRot _rlnAngleTilt "
    "_rlnAnglePsi _rlnOriginX _rlnOriginY _rlnOriginZ _rlnNormCorrection _rlnLogLikeliContribution _rlnMaxValueProbDistribution "
    "_rlnDetectorPixelSize _rlnMagnification _psSegScale _psSegRot _psSegTilt _psSegPsi _psSegOffX _psSegOffY _psSegOffZ _psPixelSize "
    "_psPixelSizeSvol _fbRadius"
).split()

REGISTRY: dict[str, T.DataType] = {c: T.StringType() for c in TEXT} | {c: T.IntegerType() for c in INTEGERS} | {c: T.DoubleType() for c in NUMBERS}


def struct(names: list[str], strict: bool = True) -> T.StructType:
    """The types of named columns. Unknown names raise, or are doubles if strict is off; repeated names always raise."""
    if len(set(names)) != len(names):
        raise ValueError("a column is repeated")
    if strict and (unknown := [n for n in names if n not in REGISTRY]):
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return T.StructType([T.StructField(n, REGISTRY.get(n, T.DoubleType())) for n in names])
