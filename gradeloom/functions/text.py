"""Names, labels and mastery colours for output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_name(name: Column) -> Column:
    """First character kept, every other one replaced by ``*``."""
    return F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.length(name) - 1))


def short_subject(label: Column) -> Column:
    """Labels over 8 characters become 4 + ``..`` + last 2."""
    return _shorten(label, "..", 2)


def short_point(label: Column) -> Column:
    """Labels over 8 characters become 4 + ``...`` + last 4."""
    return _shorten(label, "...", 4)


def short_node(label: Column) -> Column:
    """Node texts over 5 characters become 5 + ``...``."""
    return F.when(F.length(label) > 5, F.concat(F.substring(label, 1, 5), F.lit("..."))).otherwise(label)


def _shorten(label: Column, dots: str, tail: int) -> Column:
    short = F.concat(F.substring(label, 1, 4), F.lit(dots), F.substring(label, -tail, tail))
    return F.when(F.length(label) > 8, short).otherwise(label)


def number_text(score: Column) -> Column:
    """A score as displayed: ``85`` for 85.0, ``87.5`` for 87.5."""
    return F.regexp_replace(score.cast("string"), r"\.0$", "")


# Fixed values below: limits, names and colours of the bands, end colours of the
# gradients, and the text for a point that was not examined.


def _by_band(score: Column, perfect, red, blue, green, none) -> Column:
    """Band limits: 100; [0, 60); [60, 80); [80, 100); anything else."""
    return (
        F.when(score == 100, perfect)
        .when((score >= 0) & (score < 60), red)
        .when((score >= 60) & (score < 80), blue)
        .when((score >= 80) & (score < 100), green)
        .otherwise(none)
    )


def mastery_band(score: Column) -> Column:
    return _by_band(score, *(F.lit(n) for n in ("gold", "red", "blue", "green", "grey")))


def _rgb(score: Column) -> tuple[Column, Column, Column]:
    s = number_text(score)
    inverse = number_text(F.lit(255.0) - score.cast("double"))
    return (
        F.format_string("rgb(%s, %s, %s)", inverse, s, s),
        F.format_string("rgb(%s, %s, 255)", s, s),
        F.format_string("rgb(%s, 255, %s)", s, s),
    )


def mastery_colour(score: Column) -> Column:
    """Colour whose shade follows the score within its band."""
    red, blue, green = _rgb(score)
    return _by_band(score, F.lit("gold"), red, blue, green, F.lit("grey"))


def mastery_gradient(score: Column) -> Column:
    """Gradient from the score's colour to the end colour of its band."""
    red, blue, green = _rgb(score)
    return _by_band(
        score,
        _gradient(F.lit("gold"), "white"),
        _gradient(red, "black"),
        _gradient(blue, "grey"),
        _gradient(green, "antiquewhite"),
        _gradient(F.lit("#9999"), "black"),
    )


def _gradient(start: Column, end: str) -> Column:
    return F.concat(F.lit("linear-gradient(to bottom right, "), start, F.lit(f", {end})"))


def shown_score(score: Column) -> Column:
    """Text shown for a score; missing and 0 both read as not examined."""
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, F.lit("未考查")).otherwise(number_text(score))
