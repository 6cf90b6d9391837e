"""The four standard pipelines, built from flags as job documents."""

from __future__ import annotations

from typing import Any

from . import job as J

#: Fixed names and defaults of the command line's flags.
FLAGS: dict[str, Any] = {
    "cpuprofile": "", "memprofile": "", "port": 8080, "chroot": "", "setuid": -1, "job": "",
    "out": "out.fits", "jpg": "%auto", "jpgGamma": 1.0, "tiff": "", "log": "%auto",
    "pre": "", "stars": "", "back": "", "post": "", "batch": "", "dark": "", "flat": "",
    "debayer": "", "cfa": "RGGB",
    "debandH": 0.0, "debandV": 0.0, "debandHWindow": 128, "debandVWindow": 128, "debandHSigma": 3.0, "debandVSigma": 3.0,
    "binning": 0, "bpSigLow": 3.0, "bpSigHigh": 5.0,
    "starSig": 15.0, "starBpSig": -1.0, "starInOut": 1.4, "starRadius": 16,
    "backGrid": 0, "backHFRFactor": 4.0, "backSigma": 1.5, "backClip": 0, "minStars": 0,
    "blurSigma": 0.0, "usmSigma": 1.0, "usmGain": 0.0, "usmThresh": 1.0,
    "alignK": 20, "alignT": 1.0, "lsEst": 3, "normHist": 4,
    "stMode": 6, "stSigLow": 2.75, "stSigHigh": 2.75, "stWeight": 0, "stMemory": 0,
    "histoRef": "%starsHFR", "alignRef": "%starsHFR",
    "neutSigmaLow": -1.0, "neutSigmaHigh": -1.0,
    "balBlock": 16, "balBorder": 0.1, "balSkipBright": 0.0, "balSkipDim": 0.5,
    "balShR": 1.0, "balShG": 1.0, "balShB": 1.0, "balHiR": 1.0, "balHiG": 1.0, "balHiB": 1.0,
    "chromaGamma": 1.0, "chromaSigma": 1.0, "chromaFrom": 295.0, "chromaTo": 40.0, "chromaBy": 1.0,
    "rotFrom": 100.0, "rotTo": 190.0, "rotBy": 0.0, "rotSigma": 1.0, "scnr": 0.0,
    "autoLoc": 10.0, "autoScale": 0.4, "midtone": 0.0, "midBlack": 2.0, "gamma": 1.0, "ppGamma": 1.0, "ppSigma": 1.0,
    "preScale": 1.0, "preOffset": 0.0, "lumScale": 1.0, "lumOffset": 0.0, "scaleBlack": 0.0, "exportStats": "%auto",
}


#: Flags that have no meaning on Spark: a process's root and user, and a memory budget, which executors have instead.
REFUSED = ("chroot", "setuid", "stMemory")


def auto_name(value: str, out: str, suffix: str) -> str:
    """%auto: the output's name with another suffix."""
    if value != "%auto":
        return value
    for s in (".gz", ".gzip"):
        out = out.removesuffix(s)
    return out.rsplit(".", 1)[0] + suffix


def _detect(f: dict[str, Any], command: str) -> J.StarDetect:
    bad = f["starBpSig"] if f["starBpSig"] >= 0 else 5.0 if command == "stack" else 0.0
    return J.StarDetect(f["starRadius"], f["starSig"], bad, f["starInOut"], J.Save(f["stars"]) if f["stars"] else None)


def _prepared(f: dict[str, Any], command: str) -> list[J.Op]:
    low, high = (0.0, 0.0) if command == "stats" else (f["bpSigLow"], f["bpSigHigh"])
    colour = J.Debayer(f["debayer"], f["cfa"])
    return [
        J.Calibrate(f["dark"], f["flat"]),
        J.BadPixel(low, high, colour if f["debayer"] else None),
        colour,
        J.DebandHoriz(f["debandH"], f["debandHWindow"], f["debandHSigma"]),
        J.DebandVert(f["debandV"], f["debandVWindow"], f["debandVSigma"]),
        J.ScaleOffset(f["preScale"], f["preOffset"]),
        J.Bin(f["binning"]),
        _detect(f, command),
        J.BackExtract(f["backGrid"], f["backHFRFactor"], f["backSigma"], f["backClip"], J.Save(f["back"]) if f["back"] else None),
        J.ExportStats(auto_name(f["exportStats"], f["out"], ".html")),
        J.Save(f["pre"]),
    ]


def _saved(f: dict[str, Any], mode: int = 0) -> list[J.Op]:
    return [J.Save(f["out"], mode), J.Save(auto_name(f["tiff"], f["out"], ".tif"), mode, f["jpgGamma"]), J.Save(auto_name(f["jpg"], f["out"], ".jpg"), mode, f["jpgGamma"])]


def pipeline(command: str, flags: dict[str, Any], files: list[str]) -> J.Sequence:
    """The operator tree of stats, stack, stretch or rgb.  Unknown flags raise."""
    unknown = set(flags) - set(FLAGS)
    if unknown:
        raise ValueError(f"unknown flags: {', '.join(sorted(unknown))}")
    f = FLAGS | flags
    histogram = f["normHist"] if f["normHist"] != 4 else {"stack": 2, "rgb": 0}.get(command, 0)
    steps: list[J.Op] = [J.LoadMany(files)]
    if command == "stats":
        steps += _prepared(f, command)
    elif command == "stack":
        per_batch = [
            *_prepared(f, command),
            J.SelectRef(1, f["histoRef"]),
            J.SelectRef(0, f["alignRef"]),
            J.Filter(f["minStars"]),
            J.MatchHist(histogram),
            J.Align(f["alignK"], f["alignT"], 0),
            J.Save(f["post"]),
            J.Stack(f["stMode"], f["stWeight"], f["stSigLow"], f["stSigHigh"]),
            J.Save(f["batch"]),
        ]
        steps += [J.StackBatches(J.Sequence(per_batch)), _detect(f, command), *_saved(f)]
    elif command == "stretch":
        steps += [
            J.NormRange(),
            J.Stretch(f["autoLoc"] / 100, f["autoScale"] / 100),
            J.Midtones(f["midtone"], f["midBlack"]),
            J.Gamma(f["gamma"]),
            J.GammaPP(f["ppGamma"], f["ppSigma"]),
            J.ScaleBlack(f["scaleBlack"] / 100),
            _detect(f, command),
            J.SelectRef(0, f["alignRef"]),
            J.Align(f["alignK"], f["alignT"], 2),
            J.GaussianBlur(f["blurSigma"]),
            J.UnsharpMask(f["usmSigma"], f["usmGain"], f["usmThresh"]),
            *_saved(f, 1),
        ]
    elif command == "rgb":
        tint = lambda k: {"R": f[f"bal{k}R"], "G": f[f"bal{k}G"], "B": f[f"bal{k}B"]}
        steps += [
            _detect(f, command),
            J.SelectRef(0, "%rgb"),
            J.RGBCombine(),
            J.RGBBalance(f["balBlock"], f["balBorder"], f["balSkipBright"], f["balSkipDim"], tint("Sh"), tint("Hi")),
            J.RGBToHSLuv(),
            J.HSLApplyLum(),
            J.HSLUnsharpMask(f["usmSigma"], f["usmGain"], f["usmThresh"]),
            J.HSLNeutralizeBackground(f["neutSigmaLow"], f["neutSigmaHigh"]),
            J.HSLSaturationGamma(f["chromaGamma"], f["chromaSigma"]),
            J.HSLSelectiveSaturation(f["chromaFrom"], f["chromaTo"], f["chromaBy"]),
            J.HSLRotateHue(f["rotFrom"], f["rotTo"], f["rotBy"], f["rotSigma"]),
            J.HSLSCNR(f["scnr"]),
            J.HSLStretch(f["autoLoc"] / 100, f["autoScale"] / 100),
            J.HSLMidtones(f["midtone"], f["midBlack"]),
            J.HSLGamma(f["gamma"]),
            J.HSLGammaPP(f["ppGamma"], f["ppSigma"]),
            J.HSLScaleOffsetChannel(2, f["lumScale"], f["lumOffset"]),
            J.HSLScaleBlack(f["scaleBlack"] / 100),
            J.HSLuvToRGB(),
            *_saved(f, 1),
        ]
    else:
        raise ValueError(f"unknown command {command}")
    return J.Sequence(steps)
