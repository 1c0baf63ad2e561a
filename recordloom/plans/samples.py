"""Layouts of our own for the records that the queries pack and read."""

from recordloom.plans.layout import layout

ORDER = layout(
    {
        "name": "ORDER",
        "version": "V1",
        "sections": {
            "header": {
                "fields": [
                    {"name": "signature", "type": "char_array", "size": 4},
                    {"name": "version", "type": "char_array", "size": 4},
                    {"name": "key", "type": "dword", "size": 8},
                    {"name": "line_count", "type": "dword"},
                    {"name": "line_offset", "type": "dword"},
                ]
            },
            "lines": {
                "offset_field": "line_offset",
                "count": "line_count",
                "fields": [
                    {"name": "quantity", "type": "dword"},
                    {"name": "price", "type": "dword"},
                    {"name": "discount", "type": "byte"},
                    {"name": "return_flag", "type": "char_array", "size": 1},
                    {"name": "number", "type": "word"},
                ],
            },
        },
    }
)
