"""Schemas of the page relations."""

from __future__ import annotations

KEY = "doc_id long, page_num int"
BOX = "x double, y double, w double, h double"

SCHEMAS = {
    "pages": f"{KEY}, width double, height double, vp array<double>, page_width_pt double, scale double",
    "text_items": f"{KEY}, idx int, str string, transform array<double>, width double, height double, font_name string, has_eol boolean",
    "text_meta": f"{KEY}, idx int, str string, vx double, vy double, v_width double, v_font double, font_size double, font_name string, underlined boolean, bold boolean, italic boolean",
    "path_ops": f"{KEY}, op_seq int, fn string, args array<double>, sub_ops array<string>, sub_args array<double>, image_id string, mcid int",
    "segments": f"{KEY}, id string, x1 double, y1 double, x2 double, y2 double, stroke_width double, stroke_color array<double>",
    "filled_rects": f"{KEY}, seq int, {BOX}, fill_color array<double>",
    "image_meta": f"{KEY}, seq int, id string, {BOX}, inline boolean",
    "struct_nodes": f"{KEY}, node_id long, parent_id long, ord int, role string, mcid int",
    "overrides": f"{KEY}, skip array<string>, r_y_band double, r_para_gap double, r_col_gap_min double, stream_confidence double, manual_splits array<double>, custom_regions array<struct<id:string,type:string,x:double,y:double,w:double,h:double,skip:boolean,box_role:string,list_ordered:boolean>>",
    "regions": f"{KEY}, region_seq int, id string, type string, {BOX}, y_center double, column_index int, font_size double, list_ordered boolean, box_role string, fill_color array<double>, algorithm string, confidence double",
    "region_items": f"{KEY}, region_seq int, ord int, idx int",
    "tokens": "doc_id long, pos int, type string, name string, text string, page int, value int, attrs string",
    "detections": f"page_id long, id string, class_id int, {BOX}, confidence double",
    "page_results": f"{KEY}, html string, text string, tables long",
}

#: Kinds of regions.
REGION_TYPES = ("LATTICE_TABLE", "STREAM_TABLE", "TABLE", "PARAGRAPH", "HEADING", "LIST", "IMAGE", "BOX", "DIVIDER", "HEADER", "FOOTER")
