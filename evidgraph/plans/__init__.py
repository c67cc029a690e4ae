"""End-to-end plans: index, context, explain, impact, path, flow, reports."""
