"""Weights of the span model, as trained by ``pii_train``."""

WEIGHTS = {
    "account_number:digits_letter": 0.90,
    "account_number:dots_dash": 0.98,
    "account_number:iban": 1.12,
    "account_number:letter_digits": 0.88,
    "account_number:tax_code": 0.90,
    "account_number:three_two_four": 1.14,
    "account_number:two_threes": 1.10,
    "account_number_left=account_number": 3.88,
    "account_number_left=none": 3.04,
    "any:account_number": -3.29,
    "any:account_number_checked": 5.28,
    "any:account_number_date": -2.69,
    "any:account_number_digits=few": -4.90,
    "any:account_number_digits=many": 1.18,
    "any:account_number_digits=phone": 0.34,
    "any:account_number_letter": 4.85,
    "any:account_number_near=account_number": 6.31,
    "any:account_number_near=none": -0.43,
    "any:account_number_near=number": -1.35,
    "any:account_number_near=other": -7.21,
    "any:account_number_near=private_phone": -0.89,
    "any:private_phone": -2.17,
    "any:private_phone_checked": -1.48,
    "any:private_phone_date": -2.56,
    "any:private_phone_digits=few": -1.99,
    "any:private_phone_digits=many": -0.96,
    "any:private_phone_digits=phone": 0.61,
    "any:private_phone_letter": -0.11,
    "any:private_phone_near=account_number": -1.37,
    "any:private_phone_near=none": -3.01,
    "any:private_phone_near=number": 2.26,
    "any:private_phone_near=other": -3.50,
    "any:private_phone_near=private_phone": 3.38,
    "form=G*S": 0.46,
    "form=GIS": 3.80,
    "form=GS": 3.26,
    "form=GpS": 0.98,
    "form=GwS": 1.53,
    "form=IS": 0.57,
    "form=IpS": 0.15,
    "form=IwS": 0.31,
    "form=S,G": 0.79,
    "form=S,g": 0.39,
    "form=S,w": -3.54,
    "form=Sw": -5.74,
    "form=g*S": 1.00,
    "form=gIS": 2.99,
    "form=gS": 2.80,
    "form=gpS": 0.64,
    "form=gwS": 1.30,
    "form=pS,G": 3.01,
    "form=pS,g": 2.66,
    "form=wS,G": 0.77,
    "form=wS,g": 0.72,
    "form=wp": -1.92,
    "form=wpS": -5.01,
    "image": -5.26,
    "next:account_number>account_number:named": -0.16,
    "next:account_number>private_email:list": 2.83,
    "next:account_number>private_phone:named": -0.05,
    "next:private_address>private_phone:beside": 2.12,
    "next:private_person>account_number:beside": -0.45,
    "next:private_person>account_number:list": 2.45,
    "next:private_person>account_number:named": 1.63,
    "next:private_person>private_address:beside": 1.51,
    "next:private_person>private_address:list": 2.00,
    "next:private_person>private_email:list": 2.78,
    "next:private_person>private_person:beside": -0.07,
    "next:private_person>private_person:list": 8.36,
    "next:private_person>private_phone:beside": -0.33,
    "next:private_person>private_phone:list": 2.39,
    "next:private_person>private_phone:named": 10.30,
    "next:private_phone>account_number:named": 2.99,
    "next:private_phone>private_email:named": 2.69,
    "next:private_phone>private_phone:named": -0.20,
    "no_postcode": 1.48,
    "open_end": -4.01,
    "person": 1.87,
    "person_left=none": -1.14,
    "person_left=private_person": 1.53,
    "person_left=start": 1.71,
    "plain": -0.86,
    "plain_abstract": -2.30,
    "plain_common": -6.54,
    "plain_cue_abstract2": -1.32,
    "plain_cue_abstract3": -1.93,
    "plain_cue_word2": 3.29,
    "plain_cue_word3": 3.82,
    "plain_cue_word4": -0.06,
    "plain_form=Ig": 0.27,
    "plain_form=Iw": 0.68,
    "plain_form=comma": -1.50,
    "plain_form=gIg": 0.22,
    "plain_form=gIw": 0.89,
    "plain_form=gg": -0.14,
    "plain_form=ggg": 0.16,
    "plain_form=ggw": 0.27,
    "plain_form=gw": -0.22,
    "plain_form=gww": 0.28,
    "plain_form=w*w": -0.20,
    "plain_form=wIg": 0.59,
    "plain_form=wIw": 1.80,
    "plain_form=wg": -0.64,
    "plain_form=wgw": -0.25,
    "plain_form=wpP": -0.12,
    "plain_form=wpw": -0.10,
    "plain_form=ww": -1.10,
    "plain_form=wwg": -0.35,
    "plain_form=www": -1.26,
    "plain_joined_abstract2": -0.66,
    "plain_joined_abstract3": -1.42,
    "plain_joined_abstract4": -0.17,
    "plain_joined_word3": 1.11,
    "plain_joined_word4": -0.07,
    "plain_left=byline": 6.12,
    "plain_left=cue": 3.59,
    "plain_left=joined": -1.18,
    "plain_left=key": -3.72,
    "plain_left=key_name": -3.16,
    "plain_left=key_person": 6.57,
    "plain_left=none": -4.42,
    "plain_left=start": -4.06,
    "plain_none_abstract2": -0.79,
    "plain_none_abstract3": -0.35,
    "plain_none_abstract4": -0.16,
    "plain_none_word2": -2.61,
    "plain_none_word3": -0.87,
    "plain_part": -0.89,
    "plain_place": -0.33,
    "plain_runs_on": -1.21,
    "plain_upper": -1.75,
    "postcode": 3.41,
    "private_address:french": 0.75,
    "private_address:number_first": 2.18,
    "private_address:street_first": 2.05,
    "private_address_left=none": 1.83,
    "private_address_left=private_address": 1.55,
    "private_address_left=start": 1.62,
    "private_email:at_sign": 1.71,
    "private_email:at_word": 3.34,
    "private_email_left=none": 0.74,
    "private_email_left=other": -0.77,
    "private_email_left=private_email": 1.66,
    "private_email_left=start": 3.43,
    "private_phone:bracket": 1.03,
    "private_phone:dotted": 1.20,
    "private_phone:double_zero": 1.17,
    "private_phone:pairs": 1.26,
    "private_phone:plus": 2.27,
    "private_phone:slash": 1.27,
    "private_phone_left=none": 3.07,
    "private_phone_left=private_phone": 1.13,
    "private_phone_left=start": 3.94,
    "upper": 0.58,
}
