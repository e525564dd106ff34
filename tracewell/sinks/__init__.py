"""Writers of scan results. Each makes a table of text lines with an order, so that large results are written in parallel
and the part files, one after another, are the document."""

from __future__ import annotations

from .documents import cyclonedx_json, cyclonedx_xml, spdx_rdf, spdx_tag_value
from .lines import write_lines
from .pages import custom_template, html_app, html_report
from .report import Report, csv_table, json_document, json_lines, nest_files, write_csv, yaml_document

FORMATS = {
    "json": lambda r: json_document(r), "json-pp": lambda r: json_document(r, pretty=True), "json-lines": json_lines, "yaml": yaml_document,
    "spdx-tv": spdx_tag_value, "spdx-rdf": spdx_rdf, "cyclonedx": cyclonedx_json, "cyclonedx-xml": cyclonedx_xml, "html": html_report,
}


def write_report(report: Report, outputs: dict[str, str], single: bool = False) -> None:
    """Several outputs of one scan: format name to folder; csv as well as those of FORMATS."""
    for name, path in outputs.items():
        if name == "csv":
            write_csv(report, path, single)
        elif name == "html-app":
            html_app(report, path)
        else:
            write_lines(FORMATS[name](report), path, single)


__all__ = ["FORMATS", "Report", "csv_table", "custom_template", "cyclonedx_json", "cyclonedx_xml", "html_app", "html_report", "json_document", "json_lines", "nest_files", "spdx_rdf", "spdx_tag_value", "write_csv", "write_lines", "write_report", "yaml_document"]
