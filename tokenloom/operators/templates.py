"""Record shapes and the texts built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.constants import DEFAULT_BLOCK_SIZE, EOS_TOKEN, INPUT_HEADER, OUTPUT_HEADER


def record_shape(columns: list[str]) -> str:
    """``prefix``, ``instruction`` or ``plain``, from the column names present."""
    if "prefix" in columns:
        return "prefix"
    if "input" in columns:
        missing = {"instruction", "output"} - set(columns)
        if missing:
            raise ValueError(f"instruction records lack {sorted(missing)}")
        return "instruction"
    if not columns:
        raise ValueError("a record needs at least one column")
    return "plain"


def resolve_text_column(columns: list[str]) -> str:
    return "text" if "text" in columns else columns[0]


def resolve_block_size(block_size: int | None, model_max: int) -> int:
    return min(DEFAULT_BLOCK_SIZE if block_size is None else block_size, model_max)


def student_eos(eos: str | None, is_mlm: bool | Column = False) -> Column:
    """The text end of the student; a masked-LM student gets none."""
    end = F.lit(eos or "")
    if isinstance(is_mlm, bool):
        return F.lit("") if is_mlm else end
    return F.when(is_mlm, F.lit("")).otherwise(end)


def template_prefix(prefix: Column, text: Column, eos: Column) -> Column:
    return F.concat(prefix, text, eos)


def instruction_prompt(instruction: Column, given: Column) -> Column:
    """The prompt ends before the output header, so that header is trained on."""
    return F.concat(instruction, F.lit(INPUT_HEADER), given)


def template_instruction(instruction: Column, given: Column, output: Column, eos: Column) -> Column:
    return F.concat(instruction_prompt(instruction, given), F.lit(OUTPUT_HEADER), output, eos)


def template_plain(text: Column, eos: Column) -> Column:
    return F.concat(text, eos)


def prompt_and_text(
    df: DataFrame, key: str, eos: str | None = EOS_TOKEN, is_mlm: bool = False
) -> DataFrame:
    """``(key, prompt, body, text)`` of any record shape.

    ``body`` is the text before the student's end marker, which is what the appended
    teacher text starts from. ``prompt`` is NULL for plain records: nothing is masked.
    """
    columns = [c for c in df.columns if c != key]
    shape = record_shape(columns)
    nothing = F.lit("")
    if shape == "prefix":
        body_text = F.col(resolve_text_column(columns))
        prompt = F.col("prefix")
        body = template_prefix(prompt, body_text, nothing)
    elif shape == "instruction":
        fields = (F.col("instruction"), F.col("input"))
        prompt = instruction_prompt(*fields)
        body = template_instruction(*fields, F.col("output"), nothing)
    else:
        prompt = F.lit(None).cast("string")
        body = F.col(resolve_text_column(columns))
    return df.select(
        key,
        prompt.alias("prompt"),
        body.alias("body"),
        F.concat(body, student_eos(eos, is_mlm)).alias("text"),
    )


def teacher_text(text: Column, student_end: str, teacher_ends: list[str]) -> list[Column]:
    """Texts of all teachers; each replaces the student's end marker in the text that the
    teacher before it saw, so from the second on there is usually nothing left to replace."""
    out = []
    for end in teacher_ends:
        text = F.replace(text, F.lit(student_end), F.lit(end))
        out.append(text)
    return out


def teacher_text_append(body: Column, teacher_end: str | None) -> Column:
    return F.concat(body, F.lit(teacher_end or ""))
