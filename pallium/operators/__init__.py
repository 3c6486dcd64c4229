"""DataFrame operators: detection, redaction, leak scan, entities, boxes, elements, evaluation."""
